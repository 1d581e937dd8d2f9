"""skein: an event-sourced catalog and entity-resolution engine on Spark DataFrames."""
