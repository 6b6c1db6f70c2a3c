"""pointbook: conduct-point ledger analytics as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame(s) -> DataFrame`` built
from Spark SQL built-ins (joins, aggregations, windows, higher-order array
functions), so Catalyst sees one declarative plan end to end.

Sub-packages
------------
functions   scalar Column expressions (trim, number coercion, phones, templates)
sources     table reads, roster reads, versioned snapshots, seeds, stand-in views
operators   validation, mutations (merge / delete / cascade), ledger aggregates,
            threshold lookup, recipients and outbox, ordering
plans       composed pipelines and the query registry used by the driver
streaming   Structured Streaming ingest and running totals
"""

__version__ = "0.1.0"
