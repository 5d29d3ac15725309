from .bars_stream import stream_bars
from .live_stream import start_live_scoring

__all__ = ["stream_bars", "start_live_scoring"]
