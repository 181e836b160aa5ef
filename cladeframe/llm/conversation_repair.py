"""Conversation structure repair by signature deduplication.

Each conversation becomes a signature, a string with a letter a row for the row's role and fault. Conversations share
few signatures, so each distinct one is solved once: a memoised recursion over rows and the roles wanted next finds the
cheapest edits, of equally cheap ones those whose initials come first. The audits are joined back by signature, and the
edits are replayed by a join of their steps with the rows they take.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of rows by role (system, user, assistant, other): without fault, truncated, blank or repeated.
WHOLE, CUT, GONE = "suax", "SUAX", "1234"
#: What has been said so far: nothing, the system's turn, a user's, an assistant's. A conversation may end at the first and last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Neighbours that are legal.
PAIRS = {"su", "ua", "au"}
#: Copies of a solved signature: a signature of very many conversations is joined in so many parts.
SALTS = 16
#: Rows that the recursion goes down at once.
DEPTH = 100


def _wanted(state: int) -> int:
    """Whose turn is next."""
    return ASSISTANT if state == USER else USER


def solved(signature: str) -> tuple[int, str, list[tuple[int, str | None]]]:
    """(cost, audit, steps) of a signature. A step is a row from 1, or 0 for an inserted one, and the role it is given, if any."""
    n = len(signature)

    def moves(i: int, state: int, inserted: int) -> Iterator[tuple[str, int, tuple[int, int, int], int, int | None]]:
        """(edit, cost, where it leads, the row it puts out or -1, the new role) of all edits, in ASCII order."""
        letter = signature[i] if i < n else ""
        if letter:
            yield "D", DELETE, (i + 1, state, 0), -1, None
        if inserted < 2:  # two take each state to each later one; more only cost
            yield "I", INSERT, (i, _wanted(state), inserted + 1), 0, _wanted(state)
        if letter and letter not in GONE:
            whole, extra = letter.lower(), TRUNCATED if letter in CUT else 0
            if whole == "s" and state == NOTHING:
                yield "K", KEEP + extra, (i + 1, SYSTEM, 0), i + 1, None
            elif whole in "ua" and _wanted(state) == WHOLE.index(whole) + 1:
                yield "K", KEEP + extra, (i + 1, _wanted(state), 0), i + 1, None
            yield "R", REROLE + extra, (i + 1, _wanted(state), 0), i + 1, _wanted(state)

    @functools.cache
    def least(i: int, state: int, inserted: int) -> float:
        here = 0 if i == n and state in ENDS else float("inf")
        return min([here, *(cost + least(*to) for _, cost, to, _, _ in moves(i, state, inserted))])

    for i in range(n - n % DEPTH, 0, -DEPTH):  # from the end, so that no call goes deep
        for state in range(4):
            least(i, state, 0)
    at, audit, steps = (0, NOTHING, 0), [], []
    while not (at[0] == n and least(*at) == 0):
        edit, _, to, row, role = next(m for m in moves(*at) if m[1] + least(*m[2]) == least(*at))
        audit.append(edit)
        if row >= 0:
            steps.append((row, NAMES.get(role)))
        at = to
    return int(least(0, NOTHING, 0)), "".join(audit), steps


def illegal(signature: str) -> int:
    """Neighbours whose roles may not follow each other."""
    roles = signature.translate(str.maketrans(CUT + GONE, WHOLE + WHOLE))
    return sum(roles[k : k + 2] not in PAIRS for k in range(len(roles) - 1))


def solutions(signatures: DataFrame) -> DataFrame:
    """(signature, illegal, cost, audit, steps) of each distinct `signature`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.column("signature").slice(at, 64).to_pylist()
                costs, audits, steps = zip(*map(solved, own))
                steps = [[{"row": row, "role": role} for row, role in x] for x in steps]
                columns = [pa.array(own), pa.array(map(illegal, own), pa.int64()), pa.array(costs, pa.int64()), pa.array(audits), pa.array(steps, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["signature", "illegal", "cost", "audit", "steps"])

    return signatures.select("signature").distinct().mapInArrow(task, "signature string, illegal long, cost long, audit string, steps array<struct<row: int, role: string>>")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place (from 1, by turn, role and text), fault and letter of each row (conv_id, turn, role, text)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    own = Window.partitionBy("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = plain.withColumn("place", F.row_number().over(own.orderBy(*order))).withColumn("digest", F.sha2("text", 256))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("place")) > 1
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    found = placed.withColumn("again", again).withColumn("fault", fault).drop("again", "digest")
    kind = F.greatest(F.instr(F.lit("xsua"), F.substring("role", 1, 1)), F.lit(1))
    kind = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), kind).otherwise(1)
    letters = F.when(F.col("fault") == "truncated", F.lit("XSUA")).when(F.col("fault").isNotNull(), F.lit("4123")).otherwise(F.lit("xsua"))
    return found.withColumn("letter", F.substring(letters, kind, F.lit(1)))


@dataclass
class Repair:
    """`audits`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. `rows`: conv_id, place (from 1), role, text, source
    (the row's place before, 0 if inserted)."""

    audits: DataFrame
    rows: DataFrame


def repaired(rows: DataFrame) -> Repair:
    """Repairs the conversations of rows (conv_id, turn, role, text).

    Null texts and roles are one space. A conversation's rows are taken by turn (null ones first), then role and text.
    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (its end is none of .!?). Edits give
    role initials (s?(ua)+)?: Keep costs 0, Rerole 3, Delete 4 (blank and duplicate rows must go), Insert of an empty row 3, and an
    undeleted truncated row 3 more. Gaps are turns missing between the first and the last. Rows with a null conv_id are
    one conversation; an empty table gives empty tables; other columns are not read. Rows of a conversation meet in one
    task, sorted, as its signature is one string.
    """
    all_rows = written(marked(rows), "repair-rows")
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    letters = F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"])
    signed = written(all_rows.groupBy("conv_id").agg(gaps, *map(count, ("blank", "duplicate", "truncated")), F.array_join(letters, "").alias("signature")), "repair-signatures")
    known = written(solutions(signed), "repair-solutions")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = signed.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, ["signature", "salt"])
    audits = joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    steps = joined.select("conv_id", F.posexplode("steps").alias("at", "step")).select("conv_id", (F.col("at") + 1).alias("place"), F.col("step.row").alias("source"), F.col("step.role").alias("given"))
    taken = all_rows.select(F.col("conv_id").alias("of"), F.col("place").alias("old"), "role", "text")
    replayed = steps.join(taken, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("source") == F.col("old")), "left")
    return Repair(audits, replayed.select("conv_id", "place", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "source"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's `role:text` rows by place, joined by newlines, which are read one after another."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda c, h: pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([h.hexdigest()])], names=["conv_id", "sha256"])
        current, state = None, None
        for batch in batches:
            for conv, line in zip(batch.column("conv_id"), batch.column("line")):
                conv = conv.as_py()
                if state is None or conv != current:
                    if state is not None:
                        yield row(current, state)
                    current, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py())
        if state is not None:
            yield row(current, state)

    lines = rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line").mapInArrow(task, "conv_id long, sha256 string")


def _crc(*columns: str) -> Column:
    return F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns)).cast("binary"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults put in by their conv_id and turn: dropped, emptied, without full stops, repeated, or given to the user."""
    plain = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (_crc("conv_id", "turn") % 20).alias("dice"))
    dice = F.col("dice")
    text = F.when(dice == 1, "").when(dice == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(dice == 3, 2).otherwise(1)))
    return plain.filter(dice != 0).select("conv_id", "turn", F.when(dice == 4, "user").otherwise(F.col("role")).alias("role"), text, copies.alias("copy")).drop("copy")


def op13_signature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repaired(damaged(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    known = every.join(found.audits, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    shas = digests(found.rows)
    known = known.join(shas, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return known.select(F.col("id").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


def _least(*choices: str) -> str:
    return f"list_min(list_filter([{', '.join(choices)}], lambda x: x IS NOT NULL))"


def _after(state: str, edit: str, cost: str, when: str = "true") -> str:
    """SQL of a state's best edits with one more."""
    return f"CASE WHEN {when} AND {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} END"


def _sql() -> str:
    """The same by dynamic programming from the first row on: n, s, u, a are the best edits so far by what was said last."""
    extra = "(CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)"
    live = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
    to_user = [_after(x, "K", extra, f"{live} AND kind = 'u'") for x in ("fn", "fs", "fa")] + [_after(x, "R", f"3 + {extra}", live) for x in ("fn", "fs", "fa")]
    to_assistant = [_after("fu", "K", extra, f"{live} AND kind = 'a'"), _after("fu", "R", f"3 + {extra}", live)]
    system = _after("fn", "K", extra, f"{live} AND kind = 's'")
    closed = f"""SELECT *, n AS fn, s AS fs, {_least('u', _after('n', 'I', '3'), _after('s', 'I', '3'), _after('a', 'I', '3'))} AS fu,
      {_least('a', _after('u', 'I', '3'), _after('n', 'II', '6'), _after('s', 'II', '6'))} AS fa"""
    return f"""WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
diced AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1)))),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 20 AS dice FROM keyed, crc_table),
broken AS (SELECT conv_id, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role, CASE dice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN dice = 3 THEN [1, 2] ELSE [1] END) AS copy FROM diced WHERE dice <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM broken),
rows_ AS (SELECT *, substr(role, 1, 1) AS kind, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault FROM placed),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) AS size FROM rows_ GROUP BY conv_id),
pairs AS (SELECT conv_id, kind || lead(kind) OVER (PARTITION BY conv_id ORDER BY place) AS pair FROM rows_),
wrong AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS n, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS s, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS a FROM figures
  UNION ALL
  SELECT conv_id, place, {_after('fn', 'D', '4')}, {_least(_after('fs', 'D', '4'), system)}, {_least(_after('fu', 'D', '4'), *to_user)}, {_least(_after('fa', 'D', '4'), *to_assistant)}
  FROM (SELECT b.*, r.place, r.kind, r.fault FROM ({closed} FROM best) b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.place = b.i + 1)),
ended AS (SELECT conv_id, {_least('fn', 'fa')} AS e FROM ({closed} FROM best JOIN figures USING (conv_id) WHERE i = size)),
edits AS (SELECT conv_id, e.a AS audit, unnest(range(1, length(e.a) + 1)) AS k FROM ended),
taken AS (SELECT conv_id, k, substr(audit, k, 1) AS edit, length(regexp_replace(substr(audit, 1, k), 'I', '', 'g')) AS source FROM edits WHERE substr(audit, k, 1) <> 'D'),
roles AS (SELECT t.conv_id, t.k, t.edit, r.role, CASE WHEN t.edit <> 'I' THEN r.text ELSE '' END AS text, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.k) AS o,
  first_value(t.edit = 'K' AND r.kind = 's') OVER (PARTITION BY t.conv_id ORDER BY t.k) AS with_system FROM taken t LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.place = t.source),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - CAST(with_system AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS text FROM roles GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost,
  coalesce(e.a, '') AS audit, sha256(coalesce(l.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures USING (conv_id) LEFT JOIN wrong USING (conv_id) LEFT JOIN ended USING (conv_id) LEFT JOIN lines l USING (conv_id)"""


QUERIES = {"op13_signature_repair": op13_signature_repair}
SQL = {"op13_signature_repair": _sql()}
