"""chatlens — chat-log analytics on Spark.

Functions from three DataFrames (users, conversations, messages), a few
parameters and an explicit ``as_of`` time to report DataFrames. Everything is
expressed with built-in Spark expressions so Catalyst can push filters into the
scans and aggregate the fact table before it is joined to anything.
"""

from chatlens.sources.tables import ChatTables

__all__ = ["ChatTables"]
__version__ = "0.1.0"
