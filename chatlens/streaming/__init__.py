"""Structured Streaming versions of the refreshed dashboard results."""

from chatlens.streaming.additive import (ACTIVITY, ROLLUP, TOOLS, activity_from_states,
                                         compact_states, read_states,
                                         rollup_from_states, start_states,
                                         top_tools_from_states)
from chatlens.streaming.jobs import (activity_buckets, compact_conversation_rollup,
                                     dedup_messages,
                                     latest_conversation_rollup, message_stream,
                                     rollup_upserts, start_bucket_sink,
                                     start_rollup_sink, tool_buckets)
from chatlens.streaming.readback import (activity_from_buckets,
                                         top_tools_from_buckets)

__all__ = ["message_stream", "dedup_messages", "activity_buckets", "tool_buckets",
           "rollup_upserts", "start_bucket_sink", "start_rollup_sink",
           "latest_conversation_rollup", "compact_conversation_rollup", "activity_from_buckets",
           "top_tools_from_buckets", "ACTIVITY", "TOOLS", "ROLLUP", "start_states", "read_states",
           "compact_states", "activity_from_states", "top_tools_from_states", "rollup_from_states"]
