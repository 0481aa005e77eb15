"""sparkloom: log, graph, timed-text and document analytics as Spark DataFrame operators."""
