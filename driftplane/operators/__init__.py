"""Relational operators of the engine: rotation model, reconstruction, co-registration,
partitioning, kinematics, strain, rasters and topologies."""
