"""Document fingerprints by a randomised edit embedding.

A pointer walks over the characters of a text: at step j it moves on or stays by a random bit that depends only on j
and the character it is on, and that all texts share. Two texts with few edits between them have walks that meet
again after each edit, so that edit distance becomes Hamming distance between what the pointers see at each step.
The fingerprint keeps SLOTS of those steps: of all steps of a text's walk the ones with the smallest shared hash, so that
texts of similar length keep mostly the same steps. A slot is 8 bits of a hash of the WINDOW characters at the
pointer. The likeness of two fingerprints is the part of their common slots that agree, less what chance gives.

Near texts are found by banding: the bits of some slots that all texts of an octave of lengths share are keys. Texts that
share a key are verified by likeness and joined to classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import partitions, plain_text, table, written
from .components import components
from .near_texts import whole_groups, whole_keys
from .words import mixed

SLOTS = 128
WINDOW = 4
#: Values of a slot that chance makes equal: one in 256.
CHANCE = 1 / 256
#: Bands and slots a band, for candidate pairs; likeness from which two texts are near.
BANDS, BAND_SLOTS, NEAR = 16, 4, 0.8
#: Texts on each side of a cell in which a band's members are compared.
CELL = 2000
#: Characters that are walked over side by side.
CHARS = 1 << 23
_STEP_SEED, _BIT_SEED = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


# ------------------------------------------------------------------------------------------------- sampling


def steps_of(n: int) -> int:
    """Steps within which a walk over n characters ends, but for a chance of about one in 10,000."""
    return int(2 * n + 6 * np.sqrt(n)) + 1 if n else 0


@lru_cache(maxsize=64)
def _first_steps(octave: int) -> np.ndarray:
    """Of the steps below 2**octave, many of the smallest hash, in order of hash."""
    best, keys = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for first in range(0, 1 << octave, 1 << 20):  # in portions, so that very long texts need no large arrays
        steps = np.arange(first, min(first + (1 << 20), 1 << octave), dtype=np.uint64)
        best, keys = np.concatenate([best, steps]), np.concatenate([keys, mixed(steps ^ _STEP_SEED)])
        some = np.argsort(keys)[: 8 * SLOTS]
        best, keys = best[some], keys[some]
    return best


@lru_cache(maxsize=4096)
def sampled_steps(steps: int) -> np.ndarray:
    """The SLOTS steps of the smallest hash below `steps` (all, where there are no more), in order of hash."""
    if not steps:
        return np.empty(0, np.int64)
    octave = max(1, (steps - 1).bit_length())
    return np.asarray(_first_steps(octave)[_first_steps(octave) < steps][:SLOTS], np.int64)


# ----------------------------------------------------------------------------------------------------- walks


def _moves(first: int, count: int) -> np.ndarray:
    """[step, class]: whether the pointer moves on from a character of the class, 0 or 1."""
    bits = mixed(np.arange(first, first + count, dtype=np.uint64) ^ _BIT_SEED)
    return (bits[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int64)


def slot_values(texts: list[str]) -> list[np.ndarray]:
    """The slots of each text, in the order of its sampled steps: 0 past the text's end, else 1 to 255 by the characters there."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    codes = np.frombuffer("".join([*(texts[k] + "\0" * WINDOW for k in order), "\0" * 128]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = sizes[order]
    starts = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    classes = (mixed(codes.astype(np.uint64)) & np.uint64(63)).astype(np.uint8)
    steps = np.array([steps_of(int(n)) for n in sizes])
    wanted = [sampled_steps(int(s)) for s in steps]
    needed = np.unique(np.concatenate([np.empty(0, np.int64), *{int(s): w for s, w in zip(steps, wanted)}.values()]))
    pointers = starts.copy()
    ends = starts + sizes
    seen: dict[int, np.ndarray] = {}
    last = int(needed[-1]) + 1 if len(needed) else 0
    chunk, at_needed = 1 << 11, 0
    for base in range(0, last, chunk):
        moves = _moves(base, min(chunk, last - base))
        # Texts lie in order of length: those still walking are the first ones.
        active = int(np.searchsorted(-steps, -base, side="left"))
        own, stop = pointers[:active], ends[:active]
        for j in range(len(moves)):
            if at_needed < len(needed) and needed[at_needed] == base + j:
                seen[base + j] = own.copy()
                at_needed += 1
            own += moves[j][classes[own]]
            if not j & 63:
                np.minimum(own, stop, out=own)
        np.minimum(own, stop, out=own)
    found: list = [None] * len(texts)
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    for k, doc in enumerate(order):
        at = np.minimum(np.array([seen[s][k] for s in wanted[k].tolist()], np.int64), ends[k])
        h = sum(codes[at + w].astype(np.uint64) * factors[w] for w in range(WINDOW)) if len(at) else np.empty(0, np.uint64)
        found[doc] = np.where(at < ends[k], mixed(h) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8)
    return found


def fingerprint_of(n: int, values: np.ndarray) -> str:
    return f"{n:x}-{values.tobytes().hex()}"


def likeness(n: int, a: np.ndarray, m: int, b: np.ndarray) -> float:
    """How many slots agree, from 0 (as many as by chance) to 1 (all). Slots past both ends say nothing.

    Of texts of unlike length, the longer one's slots at steps that the shorter one's walk does not have disagree, as at least so many
    characters must be put in.
    """
    if n == m and np.array_equal(a, b):
        return 1.0
    if not n or not m:
        return 0.0
    x, y, beyond = a, b, 0
    if n != m:
        _, i, j = np.intersect1d(sampled_steps(steps_of(n)), sampled_steps(steps_of(m)), assume_unique=True, return_indices=True)
        x, y = a[i], b[j]
        longer, common = (a, i) if n > m else (b, j)
        beyond = np.count_nonzero(longer) - np.count_nonzero(longer[common])
    told = (x > 0) | (y > 0)
    if not told.any():
        return 0.0
    agree = float((x[told] == y[told]).sum() / (told.sum() + beyond))
    return max(0.0, (agree - CHANCE) / (1 - CHANCE))


def parsed(fingerprint: str) -> tuple[int, np.ndarray]:
    size, _, values = fingerprint.partition("-")
    return int(size, 16), np.frombuffer(bytes.fromhex(values), np.uint8)


# ------------------------------------------------------------------------------------------------- operators


def _grouped(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row; a null text counts as empty, other columns are not read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = [v for a, b in _grouped(texts) for v in slot_values(texts[a:b])]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(map(fingerprint_of, sizes, values), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_chars long, fingerprint string")


def _unpacked(packed: bytes, n_bytes: int) -> str:
    return pa.decompress(packed, n_bytes, "zstd", asbytes=True).decode()


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows in ascending order of doc_id (null first; rows of one id by the hash of their text), dealt to buckets of neighbouring ids.

    bucket, guest, doc_id, text, n_bytes: texts come compressed (see _unpacked()), as all are shuffled. Each bucket ends with a guest, the row that follows its last one, so that a task sees
    every row with its successor. The last bucket's guest is the first row of all. An id that holds many rows fills
    several buckets, dealt by the hashes of its texts.
    """
    spark = docs.sparkSession
    parts = parts or partitions(spark)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([pa.compress(x, "zstd", asbytes=True) for x in texts.to_pylist()], pa.binary())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    rows = rows.select("doc_id", packed(F.col("text").cast("binary")).alias("text"), F.octet_length("text").alias("n_bytes"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("hash"))
    cuts = [k / parts for k in range(1, parts)]
    bounds = sorted(rows.agg(F.percentile_approx("id", cuts, 20 * parts).alias("x")).first()["x"] or []) if cuts else []
    below = above = F.lit(0)
    if bounds:
        listed = F.array(*map(F.lit, bounds))
        below = F.size(F.filter(listed, lambda b: b < F.col("id")))
        above = F.size(F.filter(listed, lambda b: b <= F.col("id")))
    share = F.col("hash") / F.lit(2.0**64) + 0.5
    placed = rows.withColumn("bucket", (below + F.least(F.floor(share * (above - below + 1)), above - below)).cast("int"))
    firsts = written(placed.groupBy("bucket").agg(F.min(F.struct("id", "hash", "text", "n_bytes", "doc_id")).alias("x")), "edit-firsts")  # a row a bucket
    filled = sorted(x.bucket for x in firsts.select("bucket").collect())
    before = spark.createDataFrame([(b, filled[k - 1]) for k, b in enumerate(filled)], "first_bucket int, before int")
    guests = firsts.join(F.broadcast(before), F.col("bucket") == F.col("first_bucket"))
    own = placed.select("bucket", F.lit(False).alias("guest"), "id", "hash", "doc_id", "text", "n_bytes")
    both = own.union(guests.select("before", F.lit(True), "x.id", "x.hash", "x.doc_id", "x.text", "x.n_bytes"))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "id", "hash", "text").select("bucket", "guest", "doc_id", "text", "n_bytes")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of characters replaced by as many first ones of the following text, or all of it."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compared(docs: DataFrame) -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and its likeness to the edited and to the next text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def worked(held: list[tuple]) -> pa.RecordBatch | None:
        pairs = [(k, doc, text) for k, (_, guest, doc, text) in enumerate(held[:-1]) if not guest]
        if not pairs:
            return None
        own = slot_values([x[3] for x in held])
        changed = [edited(text, held[k + 1][3]) for k, _, text in pairs]
        values = slot_values(changed)
        rows = []
        for (k, doc, text), other, v in zip(pairs, changed, values):
            n, following = len(text), held[k + 1][3]
            rows.append((doc, n, hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_of(n, own[k]), fingerprint_of(len(other), v), likeness(n, own[k], len(other), v), likeness(n, own[k], len(following), own[k + 1])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for *row, packed, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text", "n_bytes"))):
                row = (*row, _unpacked(packed, n_bytes))
                if len(held) > 1 and size + len(row[3]) > CHARS:
                    held.append(row)
                    if found := worked(held):
                        yield found
                    held, size = [row], len(row[3])
                    continue
                held.append(row)
                size += len(row[3])
        if found := worked(held):
            yield found

    return with_next(docs).mapInArrow(task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@lru_cache(maxsize=4096)
def _shared_places(steps: int, octave: int) -> np.ndarray:
    """Where the shared steps of an octave are among the sampled steps of a text, a row a band; SLOTS for a step that isn't."""
    place = {s: k for k, s in enumerate(sampled_steps(steps).tolist())}
    found = [place.get(s, SLOTS) for s in sampled_steps(1 << max(0, octave - 1))[: BANDS * BAND_SLOTS].tolist()]
    return np.array(found + [SLOTS] * (-len(found) % BAND_SLOTS), np.int64).reshape(-1, BAND_SLOTS)


def band_keys(n: int, values: np.ndarray) -> np.ndarray:
    """The keys of a text's bands, for its octave of lengths and the one below: a text of similar length has one of them."""
    steps = steps_of(n)
    octave = max(1, (steps - 1).bit_length())
    padded = np.zeros(SLOTS + 1, np.uint8)
    padded[: len(values)] = values
    found = []
    for o in (octave, octave - 1):
        words = padded[_shared_places(steps, o)].view("<u4").ravel().astype(np.uint64)
        keys = mixed(words | np.arange(len(words), dtype=np.uint64) << np.uint64(32) | np.uint64(o << 48))
        found.append(keys[words > 0])
    return np.concatenate(found).view(np.int64)


def _slot_table(prints: list[str]) -> np.ndarray:
    """[text, step] of the slots at all steps that some of the texts sample; -1 where a text does not."""
    read = [parsed(x) for x in prints]
    steps = [sampled_steps(steps_of(n)) for n, _ in read]
    every = np.unique(np.concatenate(steps))
    found = np.full((len(read), len(every)), -1, np.int16)
    for k, ((_, values), own) in enumerate(zip(read, steps)):
        found[k, np.searchsorted(every, own)] = values
    return found


def _near_labels(part: pa.Table, near: float) -> Iterator[tuple[int, int]]:
    """Links of near texts, a guest and a home, one for each two labels of a cell that have any."""
    slots = _slot_table(part.column("fingerprint").to_pylist())
    side, owner, label = (part.column(c).to_numpy() for c in ("side", "owner", "label"))
    home = np.flatnonzero(side == 0)
    homes, seen = slots[home], set()
    for g in np.flatnonzero(side == 1):
        both = (homes >= 0) & (slots[g] >= 0)
        agree = (both & (homes == slots[g]) & (homes > 0)).sum(axis=1)
        told = (both & ((homes > 0) | (slots[g] > 0))).sum(axis=1)
        like = (agree / np.maximum(told, 1) - CHANCE) / (1 - CHANCE)
        hits = home[(like >= near) & (label[home] != label[g])]
        for other, k in zip(*np.unique(label[hits], return_index=True)):
            if (pair := (min(other, label[g]), max(other, label[g]))) not in seen:
                seen.add(pair)
                yield int(owner[g]), int(owner[hits[k]])


def near_links(texts: DataFrame, near: float = NEAR, cell: int = CELL) -> DataFrame:
    """Verified links (u, v) that join all owners which near texts of common bands join; `texts` has owner and fingerprint, each once.

    A band samples the bits of BAND_SLOTS slots among the steps that all texts of an octave of lengths have, so that a
    band's key has 32 bits, whatever the number of texts. A band's members are first compared with the smallest owner
    among them. These links make components, and then each band's members outside its largest component are compared
    with all its members of other components, in cells of about `cell` by `cell` texts, so that no near pair of a band
    stays apart. A family of near texts costs its size this way.
    """
    parts = partitions(texts.sparkSession)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(*parsed(x)) for x in batch.column("fingerprint").to_pylist()]
            owners = np.repeat(batch.column("owner").to_numpy(), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *keys])), pa.array(owners)], names=["key", "owner"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, owners), count, heads in whole_groups(batches, ("key", "owner"), np.empty(0, np.int64), 1):
            several = count > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (keys, owners, heads)], names=["key", "owner", "head"])

    # One pass over the keys in order tells those that several texts have and the smallest owner there.
    bands = texts.mapInArrow(banded, "key long, owner long").repartition(parts, "key").sortWithinPartitions("key", "owner")
    met = written(bands.mapInArrow(meeting, "key long, owner long, head long"), "edit-buckets")

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([likeness(*parsed(x), *parsed(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    pairs = met.filter("owner != head").select(F.col("owner").alias("u"), F.col("head").alias("v")).distinct()
    for end, name in (("u", "a"), ("v", "b")):
        pairs = pairs.join(texts.select(F.col("owner").alias(end), F.col("fingerprint").alias(name)), end)
    links = written(pairs.withColumn("near", alike("a", "b")).filter(F.col("near") >= near).select("u", "v"), "edit-links")

    label = components(links).select(F.col("u").alias("owner"), F.col("v").alias("label"))
    marked = written(met.join(label, "owner", "left").select("key", "owner", F.coalesce("label", "owner").alias("label")), "edit-marked")
    largest = marked.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).filter("most.n < n")
    cuts = largest.select("key", F.col("most.label").alias("most"), F.ceil(F.col("n") / cell).cast("long").alias("rows"), F.ceil((F.col("n") - F.col("most.n")) / cell).cast("long").alias("columns"))
    members = marked.join(cuts, "key").join(texts, "owner")
    spot, what = F.xxhash64("owner"), ("owner", "label", "fingerprint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    homes = members.select("key", F.pmod(spot, F.col("rows")).alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), *what)
    guests = members.filter("label != most").select("key", every("rows").alias("i"), F.pmod(F.shiftright(spot, 20), F.col("columns")).alias("j"), F.lit(1).alias("side"), *what)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, ["key", "i", "j"]):
            key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            found = [x for start, end in zip(new.tolist(), [*new[1:].tolist(), len(key)]) for x in _near_labels(rows.slice(start, end - start), near)]
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    cells = homes.union(guests).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.union(written(cells.mapInArrow(crossed, "u long, v long"), "edit-links"))


def with_classes(rows: DataFrame, near: float = NEAR, cell: int = CELL) -> DataFrame:
    """rows (doc_id, fingerprint and others; a written table, as it is read again) with class_id, the smallest doc_id that near texts reach.

    Equal fingerprints are one class, those of empty texts, too. Ids that are null are no class's smallest, unless a class
    has no others: then class_id is null.
    """
    owner = F.xxhash64("fingerprint")
    texts = written(rows.groupBy(owner.alias("owner")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("fingerprint").alias("fingerprint")), "edit-texts")
    label = components(near_links(texts.select("owner", "fingerprint"), near, cell)).select(F.col("u").alias("owner"), F.col("v").alias("label"))
    named = written(texts.drop("fingerprint").join(label, "owner", "left").withColumn("label", F.coalesce("label", "owner")), "edit-labels")
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("size")).filter("size > 1")
    several = written(named.join(classes, "label").select("owner", "class_id"), "edit-classes")
    found = rows.withColumn("owner", owner).join(several.withColumn("met", F.lit(True)), "owner", "left")
    return found.select(*rows.columns, F.when(F.col("met"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def near_classes(docs: DataFrame, near: float = NEAR, cell: int = CELL) -> DataFrame:
    """doc_id and class_id (see with_classes()) of each row."""
    return with_classes(written(fingerprints(docs), "edit-fingerprints"), near, cell).select("doc_id", "class_id")


def op9_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(written(compared(table(spark, sf_dir, "documents")), "edit-compared"))


QUERIES = {"op9_edit_embedding": op9_edit_embedding}
SQL: dict[str, str] = {}
