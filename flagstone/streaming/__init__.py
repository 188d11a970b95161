from flagstone.streaming.flag_stream import flag_stream, start_flagging

__all__ = ["flag_stream", "start_flagging"]
