"""Sources: DDL text, database catalogues, value pools and event logs."""
