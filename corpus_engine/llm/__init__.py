"""Training-data operators: archives, extraction, quality, de-duplication, mixing, counting, safety.

Nothing else in the library imports this subpackage; ``queries`` holds the registered
queries and their SQL."""
