"""engram: conversational and narrative memory as ordinary Spark transformations."""
