"""Content-addressed identities, digests and deterministic order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of an identity's fields and of lineage entries.
FIELD, ENTRY = chr(31), chr(30)


def stable_id(prefix: str, session: Column, lineage: Column, ordinal: Column) -> Column:
    """prefix and the SHA-256 of session, lineage (array of strings) and ordinal."""
    joined = F.concat_ws(FIELD, session.cast("string"), F.array_join(lineage, ENTRY), ordinal.cast("string"))
    return F.concat(F.lit(prefix), F.sha2(joined, 256))


def shuffle_key(label: str, seed: int, ordinal: Column, key: Column) -> Column:
    """Sorting by this digest, then by the key, is the same random order on every run."""
    return F.sha2(F.concat_ws(":", F.lit(label), F.lit(str(seed)), ordinal.cast("string"), key.cast("string")), 256)


def canonical_json(**columns: Column) -> Column:
    """Compact JSON with keys in code-point order and nulls left out."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def ordered_digest(order: Column, item: Column) -> Column:
    """Aggregate: SHA-256 of a group's items joined by line ends in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("x"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["x"]), "\n"), 256)
