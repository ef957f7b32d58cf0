"""Registered queries: every operator bound to the driver's tables, with an equivalent SQL text where there is one."""
