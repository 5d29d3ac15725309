import odd

from tickscope.llm import lines


def naive(rows, least):
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.encode().split():
                sites.setdefault(x, set()).add(s)
    out = []
    for i, t, _ in rows:
        parts = t.split("\n") if t is not None else []
        stay = [x for x in parts if len(sites.get(x, ())) < least]
        out.append((i, len(parts), len(parts) - len(stay), None if t is None else "\n".join(stay)))
    return sorted(out, key=str)


def result(out):
    return sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["kept"]) for r in out.collect()), key=str)


def test_odd_rows_equal_the_definition(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for least in (1, 2, 5, 7, 8):
        assert result(lines.drop_boilerplate(docs, least)) == naive(rows, least)
    assert lines.drop_boilerplate(odd.empty(spark)).count() == 0


def test_many_sites_around_the_threshold(spark, docs):
    rows = [(n * 1000 + s, f"line of {n} sites\nown {n} {s}", f"site{s}") for n in (190, 199, 200, 201, 210, 300) for s in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(lines.drop_boilerplate(frame, 200)) == naive(rows, 200)
