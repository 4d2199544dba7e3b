"""Planning helpers: nested paths, the filter language and the record query language, all compiled to Columns."""
