"""The messages of index statements, as their users know them."""

UNIQUE = "HNSW indexes do not support unique or primary key constraints"
PERSISTENCE = "HNSW indexes can only be created in in-memory databases, or when the configuration option 'hnsw_enable_experimental_persistence' is set to true."
METRIC_KIND = "HNSW index 'metric' must be a string"
METRIC_NAME = "HNSW index 'metric' must be one of: {}"
OPTION_KIND = "HNSW index '{}' must be an integer"
OPTION_LEAST = "HNSW index '{}' must be at least {}"
OPTION_UNKNOWN = "Unknown option for HNSW index: '{}'"
ONE_COLUMN = "HNSW indexes can only be created over a single column of keys."
KEY_ARRAY = "HNSW index keys must be of type FLOAT[N]"
KEY_SCALAR = "HNSW index key type must be one of: 'FLOAT[N]'"
NULL_VECTOR = "Invalid data in HNSW index construction: Cannot construct index with NULL values."
NAME_TAKEN = 'Index with name "{}" already exists'
COMPACT_COUNT = "Expected one argument for hnsw_compact_index"
COMPACT_KIND = "Expected a string argument for hnsw_compact_index"
NOT_FOUND = "Index {} not found"
METRIC_UNKNOWN = "Unknown metric"
DUPLICATE_KEYS = "Duplicate keys not allowed in high-level wrappers"
SELF_JOIN = "Can't join with itself, consider copying"
NO_CLUSTERS = "No clusters to identify"
TOO_SMALL = "Index too small to cluster!"
