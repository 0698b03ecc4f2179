"""Loading uploaded sources: both tables and the golden table seeded from the first, all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.store import Store, StoreError

#: What of a record of A a golden row takes over, besides its id.
TAKEN = "full_name email phone addr_line city postcode country date_of_birth".split()


def seed(a: DataFrame) -> DataFrame:
    """One golden row for each record of A."""
    return a.select(F.concat(F.lit("G-"), "cust_id").alias("golden_id"), *TAKEN, F.col("cust_id").alias("source_a_ref"), F.lit(None).cast("string").alias("source_b_ref"), F.lit(None).cast("string").alias("merged_a_refs"), F.lit(None).cast("timestamp_ntz").alias("merged_at"), F.lit(None).cast("string").alias("survivorship"))


def load(store: Store, a: DataFrame, b: DataFrame) -> dict[str, int]:
    """Write both sources and the seed, count what was written, and only then put the versions in force.

    The counts of what came in, for each table; ROW_COUNT_MISMATCH, with nothing in force, if one differs.
    """
    frames = {"UPLOADS.SOURCE_A": (a, "cust_id"), "UPLOADS.SOURCE_B": (b, "client_ref"), "GOLDEN.UPLOADED": (seed(a), "golden_id")}
    came = {"UPLOADS.SOURCE_A": a.count(), "UPLOADS.SOURCE_B": b.count()}
    came["GOLDEN.UPLOADED"] = came["UPLOADS.SOURCE_A"]
    with store.lock():
        versions = {t: store.write_version(t, df) for t, (df, _) in frames.items()}
        for t, v in versions.items():
            if (n := store.read(t, v).count()) != came[t]:
                raise StoreError("ROW_COUNT_MISMATCH", f"{t}: {n} of {came[t]}")
        for t, v in versions.items():
            store.publish(t, v, frames[t][1])
    return came
