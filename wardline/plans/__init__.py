"""Making plans: seeded contiguous partitions and their refinement, one state per task."""
