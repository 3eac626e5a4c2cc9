"""No streaming operators: the engine works on finished tables. Bounded memory comes from partitioned scans."""
