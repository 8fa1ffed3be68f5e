"""DataFrame operators: retrieval, calibration, statistics, audit, sweeps, worlds, runs, region store."""
