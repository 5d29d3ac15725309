"""DuckDB SQL for every oracle-checked query (independent re-statement of the semantics).

Tables ``events``, ``lineitem``, ... are views over the same parquet files. The SQL
is built from CTE fragments so each query states its whole derivation from the
source tables.
"""

from __future__ import annotations

from ..schemas import (ANOMALY_PERCENTILE, FEATURE_COLS_ALL, INTERVAL_Z, MAX_SAMPLES, MODEL_FEATURES, N_TREES,
                       SEED)

Q = '"'
OHLCV_SQL = '"Open", "High", "Low", "Close", "Volume"'
FEATS = FEATURE_COLS_ALL
MAX_DEPTH = 8
EULER = 0.5772156649015329
MIX_PRIME = 2147483647


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def bars_events(name: str = "bars") -> list[str]:
    return [f"""{name} AS (
  SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS "Date",
         arg_min(value, ts) AS "Open", max(value) AS "High", min(value) AS "Low",
         arg_max(value, ts) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume"
  FROM events GROUP BY 1, 2)"""]


def bars_daily(name: str = "bars") -> list[str]:
    k = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    p = "(l_extendedprice / nullif(l_quantity, 0))"
    return [f"""{name} AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS TIMESTAMP) AS "Date",
         arg_min({p}, {k}) AS "Open", max({p}) AS "High", min({p}) AS "Low",
         arg_max({p}, {k}) AS "Close", CAST(sum(l_quantity) AS DOUBLE) AS "Volume"
  FROM lineitem GROUP BY 1, 2)"""]


def bars_brands(name: str = "bars") -> list[str]:
    k = "(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)"
    p = "(l.l_extendedprice / nullif(l.l_quantity, 0))"
    return [f"""{name} AS (
  SELECT p.p_brand AS ticker, CAST(l.l_shipdate AS TIMESTAMP) AS "Date",
         arg_min({p}, {k}) AS "Open", max({p}) AS "High", min({p}) AS "Low",
         arg_max({p}, {k}) AS "Close", CAST(sum(l.l_quantity) AS DOUBLE) AS "Volume"
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)"""]


def features(src: str = "bars", name: str = "features") -> list[str]:
    w = "PARTITION BY ticker ORDER BY \"Date\""
    w20 = f"({w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    w50 = f"({w} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"

    def gated(agg, col, frame, n):
        return f"CASE WHEN count({col}) OVER {frame} = {n} THEN {agg}({col}) OVER {frame} END"

    r1 = f'("Close" / nullif(lag("Close", 1) OVER ({w}), 0))'
    f0 = f"""{name}_0 AS (
  SELECT *, {r1} - 1 AS daily_return,
         CASE WHEN {r1} > 0 THEN ln({r1}) END AS log_return,
         ("High" - "Low") / nullif("Close", 0) AS price_range,
         "Volume" / nullif(lag("Volume", 1) OVER ({w}), 0) - 1 AS volume_change,
         ("Volume" - {gated('avg', '"Volume"', w20, 20)}) / nullif({gated('stddev_samp', '"Volume"', w20, 20)}, 0) AS volume_zscore,
         {gated('avg', '"Close"', w20, 20)} AS ma_20,
         {gated('avg', '"Close"', w50, 50)} AS ma_50,
         "Close" / nullif(lag("Close", 5) OVER ({w}), 0) - 1 AS momentum_5d,
         "Close" / nullif(lag("Close", 20) OVER ({w}), 0) - 1 AS momentum_20d
  FROM {src})"""
    f1 = f"""{name}_1 AS (
  SELECT *, {gated('stddev_samp', 'daily_return', w20, 20)} AS volatility_20d,
         ("Close" - ma_20) / nullif(ma_20, 0) AS price_vs_ma20,
         ("Close" - ma_50) / nullif(ma_50, 0) AS price_vs_ma50
  FROM {name}_0)"""
    cols = ", ".join(FEATS)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in ["ticker", '"Date"', '"Open"', '"High"', '"Low"',
                                                          '"Close"', '"Volume"', *FEATS])
    extra = f"""{name} AS (
  SELECT * EXCLUDE ({cols}), {cols} FROM {name}_1 WHERE {notnull})"""
    return [f0, f1, extra]


def baseline(src: str = "bars", name: str = "bl", z: float = INTERVAL_Z) -> list[str]:
    t = "(epoch_us(\"Date\") / 86400000000.0)"
    return [
        f"""{name}_b AS (
  SELECT *, {t} AS _t, "Close" AS _y, dayofweek("Date") AS dow, month("Date") AS moy FROM {src})""",
        f"""{name}_trend AS (
  SELECT ticker, avg(_t) AS t_mean, avg(_y) AS y_mean,
         coalesce(covar_pop(_t, _y) / nullif(var_pop(_t), 0), 0.0) AS slope
  FROM {name}_b GROUP BY ticker)""",
        f"""{name}_r1 AS (
  SELECT b.*, tr.t_mean, tr.y_mean, tr.slope, b._y - (tr.y_mean + tr.slope * (b._t - tr.t_mean)) AS _r1
  FROM {name}_b b JOIN {name}_trend tr USING (ticker))""",
        f"""{name}_weekly AS (SELECT ticker, dow, avg(_r1) AS weekly FROM {name}_r1 GROUP BY ticker, dow)""",
        f"""{name}_r2 AS (
  SELECT r.*, w.weekly, r._r1 - w.weekly AS _r2 FROM {name}_r1 r JOIN {name}_weekly w USING (ticker, dow))""",
        f"""{name}_yearly AS (SELECT ticker, moy, avg(_r2) AS yearly FROM {name}_r2 GROUP BY ticker, moy)""",
        f"""{name}_sigma AS (
  SELECT r.ticker, coalesce(stddev_samp(r._r2 - y.yearly), 0.0) AS sigma
  FROM {name}_r2 r JOIN {name}_yearly y USING (ticker, moy) GROUP BY r.ticker)""",
        f"""{name}_fit AS (SELECT tr.*, s.sigma FROM {name}_trend tr JOIN {name}_sigma s USING (ticker))""",
        f"""{name}_yhat AS (
  SELECT b.* EXCLUDE (_t, _y, dow, moy),
         f.y_mean + f.slope * (b._t - f.t_mean) + coalesce(w.weekly, 0.0) + coalesce(y.yearly, 0.0) AS yhat,
         f.sigma AS _sigma
  FROM {name}_b b JOIN {name}_fit f USING (ticker)
  LEFT JOIN {name}_weekly w USING (ticker, dow) LEFT JOIN {name}_yearly y USING (ticker, moy))""",
        f"""{name} AS (
  SELECT * EXCLUDE (_sigma, yhat), yhat, yhat - {z!r} * _sigma AS yhat_lower, yhat + {z!r} * _sigma AS yhat_upper,
         "Close" - yhat AS residual,
         CAST(("Close" < yhat - {z!r} * _sigma) OR ("Close" > yhat + {z!r} * _sigma) AS INTEGER) AS band_anomaly
  FROM {name}_yhat)""",
    ]


def scaler(src: str = "features", name: str = "scaler") -> list[str]:
    parts = []
    for c in MODEL_FEATURES:
        parts.append(f"avg({c}) AS mean_{c}")
        parts.append(f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS std_{c}")
    return [f"""{name} AS (SELECT ticker, {', '.join(parts)}, count(*) AS n_rows FROM {src} GROUP BY ticker)"""]


def scaled(src: str = "features", sc: str = "scaler", name: str = "scaled") -> list[str]:
    xs = ", ".join(f"({c} - s.mean_{c}) / s.std_{c}" for c in MODEL_FEATURES)
    return [f"""{name} AS (SELECT f.*, [{xs}] AS x FROM {src} f JOIN {sc} s USING (ticker))"""]


def _uniform(*parts: str) -> str:
    key = " || '|' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def _below(limit: int, *parts: str) -> str:
    key = " || '|' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) % {limit})"


def _depth_limit(psi: str) -> str:
    cases = " ".join(f"WHEN {psi} <= {2 ** d} THEN {d}" for d in range(1, MAX_DEPTH))
    return f"(CASE {cases} ELSE {MAX_DEPTH} END)"


def _c(n: str) -> str:
    nd = f"CAST({n} AS DOUBLE)"
    return (f"(CASE WHEN {nd} <= 1 THEN 0.0 WHEN {nd} = 2 THEN 1.0 "
            f"ELSE 2.0 * (ln({nd} - 1.0) + {EULER!r}) - 2.0 * ({nd} - 1.0) / {nd} END)")


def forest(src: str = "scaled", name: str = "fo", n_trees: int = N_TREES,
           max_samples: int = MAX_SAMPLES, seed: int = SEED) -> list[str]:
    """Sample, then grow every tree level by level (unrolled): the same splits the Spark
    fit makes per tree in its grouped helper."""
    k = len(MODEL_FEATURES)
    m = MIX_PRIME
    ctes = [
        f"""{name}_sizes AS (
  SELECT ticker, count(*) AS n, least(count(*), {max_samples}) AS psi,
         {_depth_limit(f'least(count(*), {max_samples})')} AS depth_limit
  FROM {src} GROUP BY ticker)""",
        f"""{name}_keys AS (
  SELECT s.ticker, rk, s.x, z.n, z.psi, z.depth_limit, {_below(m, f"'{seed}'", "'row'", 's.ticker', 'rk')} AS h1,
         {_below(m, f"'{seed}'", "'tie'", 's.ticker', 'rk')} AS h2
  FROM (SELECT *, CAST(epoch_us("Date") AS VARCHAR) AS rk FROM {src}) s JOIN {name}_sizes z USING (ticker))""",
        f"""{name}_trees AS (
  SELECT ticker, CAST(t AS INTEGER) AS t, {_below(m - 1, f"'{seed}'", "'mul'", 'ticker', 'CAST(t AS VARCHAR)')} + 1 AS a,
         {_below(m, f"'{seed}'", "'add'", 'ticker', 'CAST(t AS VARCHAR)')} AS b FROM {name}_sizes, range(0, {n_trees}) AS r(t))""",
        f"""{name}_ex AS (
  SELECT k.ticker, rk, x, psi, depth_limit, t, (h1 * a + b) % {m} AS y, h2 FROM {name}_keys k JOIN {name}_trees USING (ticker))""",
        f"""{name}_l0 AS (
  SELECT ticker, t, x, depth_limit, 0 AS node FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, t ORDER BY ((y * y) % {m} * 48271 + h2) % {m}, rk) AS rn FROM {name}_ex)
  WHERE rn <= psi)""",
    ]
    mins = ", ".join(f"min(x[{j + 1}])" for j in range(k))
    maxs = ", ".join(f"max(x[{j + 1}])" for j in range(k))
    split_names, leaf_names = [], []
    for d in range(MAX_DEPTH + 1):
        rows = f"{name}_l{d}"
        ctes.append(f"""{name}_st{d} AS (
  SELECT ticker, t, node, any_value(depth_limit) AS depth_limit, count(*) AS cnt,
         [{mins}] AS mn, [{maxs}] AS mx
  FROM {rows} GROUP BY ticker, t, node)""")
        ctes.append(f"""{name}_vf{d} AS (
  SELECT *, list_filter(range(0, {k}), lambda j: mx[j + 1] > mn[j + 1] + 1e-7) AS vf FROM {name}_st{d})""")
        uf = _uniform(f"'{seed}'", "'feat'", "ticker", "CAST(t AS VARCHAR)", "CAST(node AS VARCHAR)")
        uv = _uniform(f"'{seed}'", "'thr'", "ticker", "CAST(t AS VARCHAR)", "CAST(node AS VARCHAR)")
        ctes.append(f"""{name}_sp{d} AS (
  SELECT ticker, t, node, {d} AS depth, f, mn[f + 1] + {uv} * (mx[f + 1] - mn[f + 1]) AS thr FROM (
    SELECT *, vf[CAST(floor({uf} * len(vf)) AS INTEGER) + 1] AS f FROM {name}_vf{d}
    WHERE cnt > 1 AND {d} < depth_limit AND len(vf) > 0))""")
        ctes.append(f"""{name}_lf{d} AS (
  SELECT v.ticker, v.t, v.node, {d} AS depth, v.cnt FROM {name}_vf{d} v
  ANTI JOIN {name}_sp{d} s ON v.ticker = s.ticker AND v.t = s.t AND v.node = s.node)""")
        split_names.append(f"{name}_sp{d}")
        leaf_names.append(f"{name}_lf{d}")
        if d < MAX_DEPTH:
            ctes.append(f"""{name}_l{d + 1} AS (
  SELECT r.ticker, r.t, r.x, r.depth_limit, 2 * r.node + 1 + CAST(r.x[s.f + 1] > s.thr AS INTEGER) AS node
  FROM {rows} r JOIN {name}_sp{d} s ON r.ticker = s.ticker AND r.t = s.t AND r.node = s.node)""")
    ctes.append(f"""{name}_splits AS ({' UNION ALL '.join(f'SELECT * FROM {s}' for s in split_names)})""")
    ctes.append(f"""{name}_leaves AS (
  SELECT *, depth + {_c('cnt')} AS h FROM ({' UNION ALL '.join(f'SELECT * FROM {s}' for s in leaf_names)}))""")
    ctes.append(f"""{name}_psi AS (SELECT ticker, psi FROM {name}_sizes)""")
    return ctes


def score(src: str = "scaled", fo: str = "fo", name: str = "scores", n_trees: int = N_TREES) -> list[str]:
    ctes = [f"""{name}_w0 AS (
  SELECT r.ticker, r."Date", r.x, CAST(tr.t AS INTEGER) AS t, 0 AS node
  FROM {src} r JOIN {fo}_psi USING (ticker), range(0, {n_trees}) AS tr(t))"""]
    for k in range(MAX_DEPTH):
        ctes.append(f"""{name}_w{k + 1} AS (
  SELECT w.ticker, w."Date", w.x, w.t,
         CASE WHEN s.node IS NULL THEN w.node ELSE 2 * w.node + 1 + CAST(w.x[s.f + 1] > s.thr AS INTEGER) END AS node
  FROM {name}_w{k} w LEFT JOIN {fo}_splits s ON w.ticker = s.ticker AND w.t = s.t AND w.node = s.node)""")
    ctes.append(f"""{name}_h AS (
  SELECT w.ticker, w."Date", avg(l.h) AS mean_path
  FROM {name}_w{MAX_DEPTH} w JOIN {fo}_leaves l ON w.ticker = l.ticker AND w.t = l.t AND w.node = l.node
  GROUP BY w.ticker, w."Date")""")
    ctes.append(f"""{name} AS (
  SELECT h.ticker, h."Date", h.mean_path, -pow(2.0, -h.mean_path / nullif({_c('p.psi')}, 0)) AS if_score
  FROM {name}_h h JOIN {fo}_psi p USING (ticker))""")
    return ctes


def detect(bars_ctes: list[str], n_trees: int = N_TREES, q: float = ANOMALY_PERCENTILE) -> list[str]:
    """bars -> baseline -> features -> scaler -> forest -> scores -> threshold -> results."""
    return [
        *bars_ctes,
        *baseline("bars", "bl"),
        *features("bl", "features"),
        *scaler("features", "scaler"),
        *scaled("features", "scaler", "scaled"),
        *forest("scaled", "fo", n_trees),
        *score("scaled", "fo", "scores", n_trees),
        f"""thresholds AS (SELECT ticker, quantile_cont(round(if_score, 9), {q!r}) AS threshold FROM scores GROUP BY ticker)""",
        f"""results AS (
  SELECT f.ticker, f."Date", {OHLCV_SQL}, {', '.join('f.' + c for c in FEATS)},
         s.if_score, CAST(coalesce(round(s.if_score, 9) <= t.threshold, false) AS INTEGER) AS if_anomaly,
         f.yhat, f.yhat_lower, f.yhat_upper, f.residual, f.band_anomaly,
         CAST(coalesce(round(s.if_score, 9) <= t.threshold AND f.band_anomaly = 1, false) AS INTEGER) AS consensus_anomaly
  FROM scaled f JOIN scores s USING (ticker, "Date") JOIN thresholds t USING (ticker))""",
    ]


def design(src: str = "bars", name: str = "dz") -> list[str]:
    """Scaled closes with the 53 regression columns of the trend-and-seasonality model, and y as the 54th."""
    probs = ", ".join(f"{0.8 * j / 25!r}" for j in range(1, 26))
    d = 'epoch_us("Date") / 86400000000.0::DOUBLE'
    waves = [f"{fn}({2.0 * 3.141592653589793 * i / period!r}::DOUBLE * d)" for period, order in ((7.0, 3), (365.25, 10))
             for i in range(1, order + 1) for fn in ("sin", "cos")]
    t = "((d - t0) / CASE WHEN t1 > t0 THEN t1 - t0 ELSE 1 END)"
    bends = f"list_transform(cp, lambda s: greatest({t} - (s - t0) / CASE WHEN t1 > t0 THEN t1 - t0 ELSE 1 END, 0))"
    return [
        f"""{name}_s AS (SELECT ticker, min({d}) AS t0, max({d}) AS t1, max(abs("Close")) AS y_scale,
  quantile_disc({d}, [{probs}]) AS cp FROM {src} GROUP BY ticker)""",
        f"""{name} AS (SELECT ticker, list_concat([1.0::DOUBLE, {t}], {bends}, [{', '.join(waves)}], [coalesce("Close" / nullif(y_scale, 0), 0)]) AS z
  FROM (SELECT *, {d} AS d FROM {src}) JOIN {name}_s USING (ticker))""",
    ]
