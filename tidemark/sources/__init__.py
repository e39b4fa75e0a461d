"""Tables on storage: append, persist by partition, compact, replay, key-value; and writers of Python values."""
