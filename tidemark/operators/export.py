"""Exports: the audit of change-sets, delimited files for spreadsheets, tables by name."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.browse import page
from tidemark.store import Store

#: Columns of the audit and their headings.
AUDIT = {
    "merge_id": "Change #", "run_id": "Run", "defect_class": "Change type", "branch_id": "Branch", "requested_at": "Requested at", "requested_by": "Requested by",
    "total_changed": "Rows changed", "confidence": "Confidence", "risk_score": "Risk", "tier_at_time": "Tier", "decision": "Decision", "block_reason": "Gate reason",
    "rationale": "Rationale", "resolved_at": "Decided at", "resolved_by": "Decided by", "rows_applied": "Rows applied", "rows_excluded": "Rows left out",
    "pre_merge_fingerprint": "Fingerprint before", "post_merge_fingerprint": "Fingerprint after", "reject_code": "Reject reason", "reject_note": "Reject note",
    "unmerged_at": "Undone at", "unmerge_fp_match": "Undo verified by fingerprint",
}


def audit(merges: DataFrame, branches: DataFrame) -> DataFrame:
    """Every change-set with its branch's run and kind, under the headings of AUDIT; columns that the records lack are null."""
    own = [c for c in merges.columns if c not in ("run_id", "defect_class")]
    x = merges.select(*own).join(branches.select("branch_id", *[c for c in ("run_id", "defect_class") if c in branches.columns]), "branch_id", "left")
    return x.select(*[(F.col(c) if c in x.columns else F.lit(None).cast("string")).alias(heading) for c, heading in AUDIT.items()])


def csv_chunks(df: DataFrame, rows: int = 2000) -> Iterator[str]:
    """Text of a delimited file for spreadsheets, a mark of its encoding first, some rows at a time as they are drawn."""
    shown = [F.when(F.col(f"`{c}`"), "yes").otherwise(F.when(~F.col(f"`{c}`"), "no")) if t == "boolean" else F.date_format(f"`{c}`", "yyyy-MM-dd'T'HH:mm:ss") if t.startswith("timestamp") else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    out = io.StringIO("\ufeff", newline="")
    out.seek(0, 2)
    writer = csv.writer(out)
    writer.writerow(df.columns)
    names = [f"c{i}" for i in range(len(shown))]
    for n, row in enumerate(df.select(*[c.alias(x) for c, x in zip(shown, names)]).toLocalIterator(), 1):
        writer.writerow(["" if v is None else v for v in row])
        if n % rows == 0:
            yield out.getvalue()
            out.seek(0)
            out.truncate()
    if text := out.getvalue():
        yield text


def table(store: Store, name: str, **paging) -> DataFrame:
    """A page of a governed table by its name."""
    return page(store.read(name), **paging)


def dataset(frames: dict[str, DataFrame], folder: str) -> list[str]:
    """Write each frame as a folder of delimited files; their paths."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{name}")
    return [f"{folder}/{n}" for n in frames]
