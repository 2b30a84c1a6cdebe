"""Column-level building blocks and the small numeric kernels used inside tasks."""
