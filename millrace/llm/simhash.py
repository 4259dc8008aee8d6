"""SimHash near-duplicates with multi-index hashing.

A fingerprint bit is the majority of that bit over the hashes of all word shingles. Fingerprints that
differ in at most `distance` bits are linked: the fingerprint is cut into segments of 32 bits; of three
differing bits at most one lies in one of the two segments, so a table lookup with the Hamming ball of
radius one around each segment finds every link. A pair whose segment differs in one bit is found from the
side that has this bit set, so only balls of cleared bits are enumerated. Complete distances are verified
in the join itself.

Copies share one fingerprint and are one row in the search. A fingerprint has fewer than 43,745 others in
reach, so links grow with the number of distinct fingerprints, not with its square. Components come from
`components.stars`; nothing is gathered in one task or on the driver.

Defined cases: null, empty and blank texts have the fingerprint zero and are linked like any other; texts
with fewer words than a shingle hash their whole sequence; repeated rows are returned each; rows without an id belong to
the component of the ids that share their fingerprint, have a null one if there is none, and link nothing; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.components import stars


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return majority(np.array([digest(s, 42) for s in shingles], ">u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (big-endian); none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id and its fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], names=[ident, "fp"])

    return docs.select(F.col(ident), F.col(text)).mapInArrow(work, f"{ident} {docs.schema[ident].dataType.simpleString()}, fp long")


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of class representatives whose fingerprints differ in 1 to `distance` (at most 3) bits.

    classes: fp (distinct), rep.
    """
    if not 0 < distance <= 3:
        raise ValueError("two segments with balls of radius one reach a distance of 3")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    segments = F.array(high, low.bitwiseOR(F.lit(1 << 32)))  # bit 32 tells which segment it is
    table = classes.select(F.explode(segments).alias("key"), F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    cleared = lambda s: F.transform(F.filter(bits, lambda x: s.bitwiseAND(x) != 0), lambda x: s.bitwiseAND(F.bitwise_not(x)))
    balls = classes.select("fp", "rep", F.explode(segments).alias("segment"))
    probes = balls.select(F.explode(F.concat(F.array("segment"), cleared(F.col("segment")))).alias("key"), F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    return probes.join(table, "key").where((near <= distance) & (near > 0)).select("a", "b")


def linked(prints: DataFrame, distance: int, ident: str) -> DataFrame:
    """Per fingerprint: component_id, the smallest id that links reach. prints: fp and the id."""
    classes = written(prints.groupBy("fp").agg(F.min(ident).alias("rep")))
    roots = stars(links(classes.where("rep is not null"), distance))
    return classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, fingerprint (hex) and component_id, the smallest id that links reach."""
    prints = written(fingerprints(docs, width, ident, text))
    return prints.join(linked(prints, distance, ident), "fp").select(ident, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
