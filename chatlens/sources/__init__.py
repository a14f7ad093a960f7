"""Readers and writers of the chat tables, and the test-data mapping."""

from chatlens.sources.tables import (ChatTables, append_messages, load_tables,
                                     read_jdbc_table, read_table, refresh, write_tables)
from chatlens.sources.fixtures import FIXTURE_AS_OF, from_testdata
from chatlens.sources.export import export

__all__ = ["ChatTables", "load_tables", "read_table", "read_jdbc_table",
           "write_tables", "append_messages", "refresh", "from_testdata", "FIXTURE_AS_OF", "export"]
