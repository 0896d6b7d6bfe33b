"""The three base tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from shelfwise.workspace import materialise


@dataclass(frozen=True)
class Star:
    """Products (one row per id), sales, and external factors (one row per date).

    The keys hold and every sale has its product, as ``plans.load`` enforces; ``plans.quality`` reports on it.
    ``sales`` has the column ``sales_id`` only where row numbers were asked for. ``written`` says that products and factors
    are plain tables.
    """

    products: DataFrame
    sales: DataFrame
    factors: DataFrame
    written: bool = False

    def with_written_dimensions(self) -> Star:
        """The same star with both dimension tables written out, unless they are already.

        For row-level joins: over plain scans Spark can split a product that holds many sales across
        tasks (AQE skew join), which it does not do over an aggregate.
        """
        if self.written:
            return self
        return replace(
            self,
            products=materialise(self.products, "products"),
            factors=materialise(self.factors, "factors"),
            written=True,
        )

    def with_written_products(self) -> Star:
        """The same star with the products written out, for row-level joins that need no factors."""
        return self if self.written else replace(self, products=materialise(self.products, "products"))
