"""Chat formatting by schema fingerprints.

Records come in many layouts (prompt/response columns, instruction/input/
output, message lists). Of the nested field paths that some mapping names,
those that a record really fills are hashed; each mapping knows the hashes of
its own paths, and the matching one gives canonical turns. Where several match,
the one with the most filled paths is taken; of equals, the first in the list.
The turns are of type ``array<struct<role, text>>``. The turns are then written with
a template that marks them and escapes control strings inside texts, together
with a loss mask over the assistant texts.

Everything is built-in expressions: one projection per record, plus one
grouping where turns come as rows. A conversation is one output row, so its
size is bounded by what one formatted text may be.

Defined results: a null text or role is an empty one; a record without any
filled field, or whose paths match no mapping, has ``layout`` null and no
turns, and formats to an empty text (with ``strict``, which the query sets, one
with filled paths but no mapping is an error); extra columns are ignored unless a
mapping names them; ties of turn numbers are ordered by role, then text;
repeated rows are repeated turns; rows without conversation id form one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from furrow.llm.common import sha256_hex
from furrow.sources.tables import load

# The template's markers, and the control strings of common
# chat templates that must not appear inside a text.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
           "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]

# Declarative mappings. ``each``: a list of messages with a role and a text
# field; ``turns``: (role, fields) pairs, the fields joined by a blank line.
# ``optional`` paths may be absent; every combination has its fingerprint.
LAYOUTS = [
    {"name": "messages", "each": "messages", "role": "role", "text": "content"},
    {"name": "sharegpt", "each": "conversations", "role": "from", "text": "value",
     "roles": {"human": "user", "gpt": "assistant", "bot": "assistant"}},
    {"name": "instruction", "turns": [("system", ["system"]), ("user", ["instruction", "input"]),
                                      ("assistant", ["output"])],
     "optional": ["system", "input", "output"]},
    {"name": "prompt", "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])],
     "optional": ["system", "response"]},
    {"name": "completion", "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "question", "turns": [("user", ["context", "question"]), ("assistant", ["answer"])],
     "optional": ["context", "answer"]},
]
TURNS = "array<struct<role:string,text:string>>"


def field_paths(dtype: DataType, value: Column, name: str) -> list[Column]:
    """Columns that give a path string where the field is filled, else null."""
    if isinstance(dtype, StructType):
        return [p for f in dtype.fields for p in field_paths(f.dataType, value.getField(f.name), f"{name}.{f.name}")]
    if isinstance(dtype, ArrayType):
        out = [F.when(value.isNotNull(), F.lit(f"{name}[]"))]
        if isinstance(dtype.elementType, StructType):
            for f in dtype.elementType.fields:
                filled = F.exists(F.transform(value, _field(f.name)), lambda x: x.isNotNull())
                out.append(F.when(filled, F.lit(f"{name}[].{f.name}")))
        return out
    return [F.when(value.isNotNull(), F.lit(name))]


def _field(name: str):
    return lambda x: x.getField(name)


def filled_paths(records: DataFrame, columns: list[str], named: set[str]) -> Column:
    """The sorted paths among ``named`` that a record fills in ``columns``."""
    paths = [p for c in columns for p in field_paths(records.schema[c].dataType, F.col(c), c)]
    return F.filter(F.array_sort(F.array_compact(F.array(*paths))), lambda p: p.isin(*sorted(named)))


def fingerprint(paths: Column) -> Column:
    """SHA-256 of sorted paths."""
    return F.sha2(F.array_join(paths, "\n").cast("binary"), 256)


def _paths(layout: dict) -> tuple[list[str], list[str]]:
    if "each" in layout:
        each = f"{layout['each']}[]"
        return [each], [f"{each}.{layout['role']}", f"{each}.{layout['text']}"]
    optional = layout.get("optional", [])
    fields = [f for _, fs in layout["turns"] for f in fs]
    return [f for f in fields if f not in optional], optional


def layout_fingerprints(layout: dict) -> list[str]:
    required, optional = _paths(layout)
    return [hashlib.sha256("\n".join(sorted([*required, *some])).encode()).hexdigest()
            for k in range(len(optional) + 1) for some in combinations(optional, k)]


def _columns(layout: dict) -> list[str]:
    return [layout["each"]] if "each" in layout else [f for _, fs in layout["turns"] for f in fs]


def _turns(layout: dict, have: set[str]) -> Column:
    if "each" in layout:
        roles = layout.get("roles", {})

        def role(x):
            r = F.coalesce(x.getField(layout["role"]), F.lit(""))
            if not roles:
                return r
            known = F.create_map(*[F.lit(v) for kv in roles.items() for v in kv])
            return F.coalesce(known[r], r)

        return F.transform(F.col(layout["each"]), lambda x: F.struct(
            role(x).alias("role"), F.coalesce(x.getField(layout["text"]), F.lit("")).alias("text")))
    out = []
    for role_name, fields in layout["turns"]:
        cols = [F.col(f) for f in fields if f in have]
        if cols:
            filled = F.coalesce(*cols).isNotNull()
            out.append(F.when(filled, F.struct(F.lit(role_name).alias("role"),
                                               F.concat_ws("\n\n", *cols).alias("text"))))
    return F.array_compact(F.array(*out))


def _matching(paths: Column, layouts: list[dict]) -> Column:
    """The name of the matching layout with the most filled paths, or null."""
    def match(i, x):
        own = F.filter(paths, lambda p: p.isin(*[q for part in _paths(x) for q in part]))
        found = F.struct(F.size(own).alias("n"), F.lit(-i).alias("first"), F.lit(x["name"]).alias("name"))
        return F.when(fingerprint(own).isin(*layout_fingerprints(x)), found)

    return F.array_max(F.array(*[match(i, x) for i, x in enumerate(layouts)]))["name"]


def canonical_turns(records: DataFrame, layouts: list[dict] = LAYOUTS, strict: bool = False) -> DataFrame:
    """Add ``schema_fingerprint``, ``layout`` and ``turns``."""
    have = set(records.columns)
    usable = [x for x in layouts if set(_columns(x)) - set(x.get("optional", [])) <= have]
    named = list(dict.fromkeys(c for x in layouts for c in _columns(x) if c in have))
    paths = filled_paths(records, named, {p for x in layouts for part in _paths(x) for p in part}) if named else None
    if not usable:
        return (records.withColumn("schema_fingerprint", fingerprint(paths) if named else F.lit(None).cast("string"))
                .withColumn("layout", F.lit(None).cast("string"))
                .withColumn("turns", F.array().cast(TURNS)))
    layout = _matching(paths, usable)
    if strict:
        refused = F.raise_error(F.concat(F.lit("no mapping for the filled paths "), F.array_join(paths, ", "))).cast("string")
        layout = F.coalesce(layout, F.when(F.size(paths) > 0, refused))
    # Both at once, as a column named layout may be in the records.
    out = records.withColumns({"schema_fingerprint": fingerprint(paths), "layout": layout})
    turns = F.array().cast(TURNS)
    for x in reversed(usable):
        turns = F.when(F.col("layout") == x["name"], _turns(x, have).cast(TURNS)).otherwise(turns)
    return out.withColumn("turns", turns)


def _control_pattern() -> str:
    """A control string's first character, where the whole string follows."""
    rest = {}
    for c in CONTROL:
        rest.setdefault(c[0], []).append(r"\Q" + c[1:] + r"\E")
    return {k: f"\\Q{k}\\E(?=" + "|".join(v) + ")" for k, v in rest.items()}


def escape(text: Column) -> Column:
    """Make a text free of control strings; ``unescape`` gives it back exactly:
    every raw ``&`` is escaped first, so no reference in the result is the
    text's own."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for first, pattern in _control_pattern().items():
        out = F.regexp_replace(out, pattern, f"&#{ord(first)};")
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    out = text
    for first in [*_control_pattern(), "\n"]:
        out = F.replace(out, F.lit(f"&#{ord(first)};"), F.lit(first))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def format_turns(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_mask``: runs of (code points, in loss) that
    add up to the formatted text, three runs a turn (head, body, end)."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    df = df.withColumn("_pieces", pieces)
    runs = F.flatten(F.transform("_pieces", lambda p: F.array(
        F.struct(F.length(p["head"]).alias("n"), F.lit(False).alias("loss")),
        F.struct(F.length(p["body"]).alias("n"), p["loss"].alias("loss")),
        F.struct(F.lit(len(END)).alias("n"), F.lit(False).alias("loss")))))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return df.withColumn("formatted", text).withColumn("loss_mask", runs).drop("_pieces")


def read_back(df: DataFrame) -> DataFrame:
    """Parse ``formatted`` and ``loss_mask`` alone: add ``read_turns`` and
    ``loss_text`` (all text under the mask, unescaped, in order)."""
    parts = F.split("formatted", r"\Q" + END + r"\E")
    marked = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    df = df.withColumn("_read", F.transform(marked, lambda p: F.struct(
        F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1).alias("role"),
        F.substr(p, F.instr(p, "\n") + 1).alias("body"))))
    # The run of a turn's body is the second of its three; its length is the
    # body's, so the mask covers whole bodies and nothing between them.
    under = F.filter(
        F.transform("_read", lambda r, i: F.struct(
            r["body"].alias("body"), F.get("loss_mask", i * 3 + 1).alias("run"))),
        lambda x: x["run"]["loss"])
    loss = F.array_join(F.transform(under, lambda x: unescape(F.substr(x["body"], F.lit(1), x["run"]["n"]))), "")
    turns = F.transform("_read", lambda r: F.struct(
        unescape(r["role"]).alias("role"), unescape(r["body"]).alias("text")))
    return df.withColumn("read_turns", turns).withColumn("loss_text", loss).drop("_read")


def group_turns(rows: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) to one record per conversation."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(listed.alias("_t")).select(
        "conv_id", F.transform("_t", lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("content"))).alias("messages"))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = group_turns(rows)
    same = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast(records.schema["conv_id"].dataType).alias("conv_id"),
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit(same).alias("content"))
                  for r in ("user", "assistant")]).alias("messages"))
    done = read_back(format_turns(canonical_turns(records.unionByName(extra), strict=True)))
    spoken = F.array_join(F.transform("read_turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("read_turns").cast("bigint").alias("n_turns"),
        sha256_hex(spoken).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        sha256_hex(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "layout")


QUERIES = {"op3_chat_format": op3_chat_format}
# The same turns, hashed straight from the rows. A formatted turn is its
# markers, the role and the text; each escape makes one character five.
_CONTROLS = "|".join(c.replace("|", "[|]").replace("[INST]", "\\[INST\\]").replace("[/INST]", "\\[/INST\\]")
                     for c in CONTROL)
ORACLES = {"op3_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', 'x'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', 'x'),
e AS (
  SELECT *, {len(START) + 1 + len(END)} + length(role) + length(text)
    + 4 * (length(role || text) - length(replace(role || text, '&', ''))
           + len(regexp_extract_all(text, '{_CONTROLS}')) + len(regexp_extract_all(role, '{_CONTROLS}')))
    + 4 * (length(role) - length(replace(role, chr(10), ''))) AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)
                  FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 'messages' AS layout
FROM e GROUP BY conv_id"""}
