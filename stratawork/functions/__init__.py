from . import cleaning, nulls, ordering, scalars

__all__ = ["cleaning", "nulls", "ordering", "scalars"]
