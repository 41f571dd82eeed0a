"""Training-data operators: one module per operator, with its query and SQL.

Nothing outside this folder imports it; ``__spark_entry__`` adds the queries when it is there.
"""
