"""Sources and sinks: bar / indicator tables, landed vendor quotes, result documents, ledgers."""
