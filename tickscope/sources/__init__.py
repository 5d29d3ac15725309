from .bars import (bars_from_events, bars_from_lineitem, bars_from_brands, read_table,
                   read_bars_csv, write_bars, date_range, load_status, recent_bars)

__all__ = ["bars_from_events", "bars_from_lineitem", "bars_from_brands", "read_table",
           "read_bars_csv", "write_bars", "date_range", "load_status", "recent_bars"]
