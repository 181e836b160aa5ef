"""Chat formatting by schema fingerprints.

A record is a JSON value or a typed row of any layout: rows by turn, message lists, prompt and answer, instruction and
input. Its fingerprint is a hash of its nested field paths without the values' types; typed rows have that of their schema, and their
texts never pass a JSON parser, whose strings have a limit. A mapping says declaratively where a layout
keeps its turns, and names the layout it is for; records are joined to mappings by fingerprint. Records whose
fingerprint no mapping has are kept apart with it, not guessed at.

Formatted output has one row a turn, whose segments in order make the conversation's text, so that a conversation
may be of any length. A template marks each turn; inside texts, the characters that its marks begin with are
escaped, so that no text can forge a mark and every text reads back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ._shared import partitions, table

# ------------------------------------------------------------------------------------------------- mappings


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    `layout` is the structure that the fingerprint hashes: objects with their fields in order of name, arrays, and _
    for any plain value. `each` is the path of a list of turns, of which `role` and `text` are paths; without
    `each`, `turns` lists (role, path) of turns at fixed places, of which absent or empty optional ones are left out.
    """

    name: str
    layout: str
    each: str | None = None
    role: str = "$.role"
    text: str = "$.content"
    turns: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.layout.encode()).hexdigest()


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("turn rows", "OBJECT<conv_id: _, role: _, text: _, turn: _>", each="$", text="$.text"),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>", each="$.messages", roles=_SPEAKERS),
    Mapping("bare messages", "ARRAY<OBJECT<content: _, role: _>>", each="$", roles=_SPEAKERS),
    Mapping("speakers", "OBJECT<conversations: ARRAY<OBJECT<from: _, value: _>>>", each="$.conversations", role="$.from", text="$.value", roles=_SPEAKERS),
    Mapping("prompt and completion", "OBJECT<completion: _, prompt: _>", turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt and response", "OBJECT<prompt: _, response: _>", turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("system, prompt and response", "OBJECT<prompt: _, response: _, system: _>", turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("instruction", "OBJECT<instruction: _, output: _>", turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction and input", "OBJECT<input: _, instruction: _, output: _>", turns=(("user", "$.instruction|$.input"), ("assistant", "$.output"))),
)


def layout_of(record: Column) -> Column:
    """The nested field paths of a variant as one string: objects' fields in order of name, arrays, and _ for plain values."""
    kinds = r"\b(VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(record), kinds, "_")


def fingerprint_of(record: Column) -> Column:
    return F.sha2(layout_of(record), 256)


def fingerprinted(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records (with a JSON string column `record`) with `body`, `fingerprint` and `mapping`, the name of the layout or null.

    Text that is not JSON, and null, has a null fingerprint and no mapping.
    """
    known = records.sparkSession.createDataFrame([(m.fingerprint, m.name) for m in mappings], "known string, mapping string")
    parsed = records.withColumn("body", F.try_parse_json("record")).withColumn("fingerprint", fingerprint_of(F.col("body")))
    # The mappings are a fixed list, so this broadcast does not grow with the data.
    return parsed.join(F.broadcast(known), F.col("fingerprint") == F.col("known"), "left").drop("known")


def layout_of_type(kind: DataType) -> str:
    """The layout of a typed record: what layout_of() says of its values."""
    if isinstance(kind, StructType):
        return f"OBJECT<{', '.join(f'{x.name}: {layout_of_type(x.dataType)}' for x in sorted(kind.fields, key=lambda x: x.name))}>"
    return f"ARRAY<{layout_of_type(kind.elementType)}>" if isinstance(kind, ArrayType) else "_"


def _variant_at(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, path, kind)


def _typed_at(body: Column, path: str, kind: str = "string") -> Column:
    for name in path.split(".")[1:]:
        body = body.getField(name)
    return body.cast(kind) if kind == "string" else body


def _at(body: Column, paths: str, get=_variant_at) -> Column:
    """The text at a path; of several paths, those with text, joined by a blank line."""
    found = [F.coalesce(get(body, p), F.lit("")) for p in paths.split("|")]
    return found[0] if len(found) == 1 else F.array_join(F.filter(F.array(*found), lambda x: x != ""), "\n\n")


def _role(value: Column, mapping: Mapping) -> Column:
    found = F.coalesce(value, F.lit(""))
    for was, now in mapping.roles:
        found = F.when(F.lower(found) == was, now).otherwise(found)
    return found


def _turns_of(mapping: Mapping, body: Column, get=_variant_at) -> Column:
    """The array of turns (role, text) of a record."""

    def turn(item: Column) -> Column:
        role, text = get(item, mapping.role), get(item, mapping.text)
        return F.struct(_role(role, mapping).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if mapping.each is not None:
        items = F.array(body) if not mapping.layout.startswith("ARRAY") and mapping.each == "$" else get(body, mapping.each, "array<variant>")
        return F.transform(items, turn)
    fixed = [F.struct(F.lit(role).alias("role"), _at(body, path, get).alias("text"), F.lit(role == "system").alias("optional")) for role, path in mapping.turns]
    kept = F.filter(F.array(*fixed), lambda x: ~x["optional"] | (x["text"] != ""))
    return F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))


def typed_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """canonical_turns() of records whose column `record` is typed: the schema's fingerprint chooses the mapping. Texts may have any length."""
    layout = layout_of_type(records.schema["record"].dataType)
    by = {m.fingerprint: m for m in mappings}
    mapping = by.get(hashlib.sha256(layout.encode()).hexdigest())
    found = _turns_of(mapping, F.col("record"), _typed_at) if mapping else F.lit(None)
    return _exploded(records.select("conv_id", "place", found.cast(TURNS).alias("turns")))


def row_fingerprint(record: Column, kind: StructType) -> Column:
    """The fingerprint of a typed record whose fields are alternative layouts: a hash of the nested field paths that the row holds."""
    held = F.array(*(F.when(record.getField(x.name).isNotNull(), layout_of_type(x.dataType)) for x in kind.fields))
    return F.sha2(F.array_join(F.array_compact(held), "|"), 256)


def mixed_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """canonical_turns() of typed records of several layouts, one a row: `record` is a struct with a field for each layout, of which a row has one.

    Each row's fingerprint is joined to the mappings. Rows that hold no layout, several, or an unknown one give no turns. Texts may
    have any length.
    """
    kind = records.schema["record"].dataType
    known = records.sparkSession.createDataFrame([(m.fingerprint, m.name) for m in mappings], "known string, mapping string")
    marked = records.select("conv_id", "place", "record", row_fingerprint(F.col("record"), kind).alias("fingerprint"))
    # The mappings are a fixed list, so this broadcast does not grow with the data.
    named = marked.join(F.broadcast(known), F.col("fingerprint") == F.col("known"))
    found = F.lit(None).cast(TURNS)
    for field in kind.fields:
        for m in mappings:
            if m.layout == layout_of_type(field.dataType):
                found = F.when(F.col("mapping") == m.name, _turns_of(m, F.col("record").getField(field.name), _typed_at).cast(TURNS)).otherwise(found)
    return _exploded(named.select("conv_id", "place", found.alias("turns")))


TURNS = "array<struct<role: string, text: string>>"


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "place", F.posexplode("turns").alias("part", "turn")).select("conv_id", "place", "part", "turn.role", "turn.text")


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """A row a turn: conv_id, place (of the record in its conversation, then of the turn in its record), role, text.

    `records` has conv_id, place (a long) and record. A null text or role is an empty one. Records of unknown
    layout give no turns; unmapped() has them.
    """
    known = fingerprinted(records.select("conv_id", "place", "record"), mappings)
    found = F.lit(None).cast(TURNS)
    for m in mappings:
        found = F.when(F.col("mapping") == m.name, _turns_of(m, F.col("body")).cast(TURNS)).otherwise(found)
    return _exploded(known.filter("mapping is not null").select("conv_id", "place", found.alias("turns")))


def unmapped(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """How many records there are of each fingerprint that no mapping has, with their layout."""
    odd = fingerprinted(records, mappings).filter("mapping is null")
    return odd.groupBy("fingerprint").agg(F.first(layout_of(F.col("body"))).alias("layout"), F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------- template


@dataclass(frozen=True)
class Template:
    """Marks of turns. The first characters of marks, and the escape character, are escaped inside texts and roles."""

    begin: str = "<s>"
    user: tuple[str, str] = ("[INST] ", " [/INST]")
    assistant: tuple[str, str] = ("", "</s>")
    other: tuple[str, str, str] = ("[TURN ", "] ", " [/TURN]")
    escape: str = "\\"
    escaped: str = "\\[]<"

    def quoted(self, text: Column) -> Column:
        return F.regexp_replace(text, f"[{re.escape(self.escaped)}]", r"\\$0")

    def unquoted(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def parts(self, role: Column, text: Column) -> tuple[Column, Column, Column]:
        """What comes before the text, the text, and what comes after it."""
        user, assistant = role == "user", role == "assistant"
        before = F.when(user, self.user[0]).when(assistant, self.assistant[0]).otherwise(F.concat(F.lit(self.other[0]), self.quoted(role), F.lit(self.other[1])))
        after = F.when(user, self.user[1]).when(assistant, self.assistant[1]).otherwise(self.other[2])
        return before, self.quoted(text), after

    def reader(self) -> re.Pattern:
        body = r"((?:[^\\\[\]<]++|\\.)*+)"  # possessive: a text of any length leaves no way back
        user = re.escape(self.user[0]) + body + re.escape(self._closing(self.user[1])[1])
        other = re.escape(self.other[0]) + body + re.escape(self.other[1]) + body + re.escape(self._closing(self.other[2])[1])
        assistant = re.escape(self.assistant[0]) + body + re.escape(self._closing(self.assistant[1])[1])
        return re.compile(f"(?:{user}|{other}|{assistant})", re.S)

    def _closing(self, mark: str) -> tuple[str, str]:
        """The part of a closing mark that a body takes along, and the rest, which begins with an escaped character."""
        cut = next(k for k, x in enumerate(mark) if x in self.escaped)
        return mark[:cut], mark[cut:]

    def _body(self, text: str, mark: str, at: int) -> str:
        lead = self._closing(mark)[0]
        if not text.endswith(lead):
            raise ValueError(f"no closing mark of the turn at {at}")
        return self.unquoted(text[: len(text) - len(lead)])

    def read(self, formatted: str, first: bool = True) -> list[tuple[str, str]]:
        """The turns of a formatted text; `first` if it begins its conversation. An error if it has anything else."""
        at, found, reader = len(self.begin) if first else 0, [], self.reader()
        if first and not formatted.startswith(self.begin):
            raise ValueError("a formatted conversation lacks its begin mark")
        while at < len(formatted):
            m = reader.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            if m[1] is not None:
                found.append(("user", self._body(m[1], self.user[1], at)))
            elif m[2] is not None:
                found.append((self.unquoted(m[2]), self._body(m[3], self.other[2], at)))
            else:
                found.append(("assistant", self._body(m[4], self.assistant[1], at)))
            at = m.end()
        return found


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """turns with `segment`, the turn's part of the formatted text, and the place of its text under the loss mask.

    loss_start and loss_length count characters from the segment's begin; a turn that is not the assistant's has
    length 0. The begin mark belongs to the first segment of a conversation, which `first` tells.
    """
    before, text, after = template.parts(F.col("role"), F.col("text"))
    marked = turns.select("*", F.concat(before, text, after).alias("segment"), F.length(before).alias("loss_start"), F.when(F.col("role") == "assistant", F.length(text)).otherwise(0).alias("loss_length"))
    return marked.drop("text")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """What formatted conversations say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments are dealt by conversation, sorted, and streamed: a task holds one batch of them, however long the
    conversation is. Rows with equal places keep a fixed order, by role and then text.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list = []
        done: list[tuple] = []

        def finish() -> None:
            if current:
                conv, n, turns, loss_chars, loss, chars = current
                done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for conv, segment, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length"))):
                if not current or current[0] != conv:
                    finish()
                    current[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len(template.begin)]
                for role, text in template.read(segment, first=False):
                    current[1] += 1
                    current[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = template.unquoted(segment[start : start + length])
                current[3] += len(loss)
                current[4].update(loss.encode("utf-8", "surrogatepass"))
                current[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done.clear()
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    parts = partitions(segments.sparkSession)
    dealt = segments.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place", "part", "role", "segment")
    return dealt.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Each row of a table by turn as a typed record; its place is its turn, null turns first."""
    fields = F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("place"), fields.alias("record"))


def mixed_records(conversations: DataFrame) -> DataFrame:
    """Each row of a table by turn as a typed record in one of four layouts, dealt by turn; roles that layouts have no name for stay rows by turn."""
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    spoken = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    way = F.when(role.isin("user", "assistant", "system"), F.pmod(F.col("turn").cast("long"), F.lit(4)))
    layouts = [
        (F.coalesce(way == 0, F.lit(True)), F.struct(F.col("conv_id").cast("long").alias("conv_id"), role.alias("role"), text.alias("text"), F.col("turn").cast("long").alias("turn")), "rows"),
        (way == 1, F.struct(F.array(F.struct(text.alias("content"), role.alias("role"))).alias("messages")), "messages"),
        (way == 2, F.array(F.struct(text.alias("content"), role.alias("role"))), "bare"),
        (way == 3, F.struct(F.array(F.struct(spoken.alias("from"), text.alias("value"))).alias("conversations")), "speakers"),
    ]
    record = F.struct(*(F.when(chosen, layout).alias(name) for chosen, layout, name in layouts))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("place"), record.alias("record"))


def op1_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    # The table has one layout; its rows are dealt to four, so that each one's mapping is found by its own fingerprint.
    return read_back(formatted(mixed_turns(mixed_records(rows))))


QUERIES = {"op1_schema_fingerprints": op1_schema_fingerprints}
#: The same counts and digests from the turns themselves; marks and escapes are counted by their lengths.
SQL = {
    "op1_schema_fingerprints": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) AS quoted,
         length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) AS quoted_role FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(3 + sum(quoted + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 16 + quoted_role END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""
}
