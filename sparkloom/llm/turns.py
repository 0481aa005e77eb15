"""Speech transcripts as ordered, clean speaker turns.

1. Mining. The first ``DEPTH`` tokens of every text, with letters and digits masked, are its path in a
   token tree, up to a token that ends in a colon. The lines below each node are counted; a branch that
   holds less than ``SUPPORT`` of its parent's lines ends in a wildcard, and the paths through it become
   one layout. Stamps (the column ``timestamp``) are reduced to layouts by masking their numbers.
2. Slots. A layout of texts has a clock slot if its lines mostly open with a clock, and a speaker slot if
   what stands before their colon mostly means someone of the recording's cast ("Note:" does not). A layout
   of stamps has the hour, minute and second slots that its marks show, if the numbers in them mostly
   stay below sixty.
3. Extraction. The slots of its layouts are applied to each line: seconds, person, and speech without
   clocks, labels and annotations. What stands in a speaker slot is a label even where it names nobody.
4. Merging. Lines are ordered and merged to turns.

No step holds a recording in one task. Labels are resolved once per recording and spelling and joined
back by blocks of line numbers; lines are cut into blocks to carry times forward, and into range-sorted
chunks to encode turns; what crosses the ends of blocks and chunks is merged from one row per block or
chunk. Texts are read once and carried on only where turns with text are asked for.

Defined cases: a line with null or empty text is no speech; a label that names nobody of the cast, or
a role that several share, counts as none; speech before any label has a null speaker; lines without
a readable time before the first one that has it stand first; equal times are ordered by ``line_no``;
lines delivered again count once; recordings without cast give turns with null speakers; lines without a
``doc_id`` or ``line_no`` belong to no recording and are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.skew import block_join, salted_join
from sparkloom.session import cut, stored

#: Depth of the token tree: a label ends within the first tokens of its line.
DEPTH = 5
#: Share of a node's lines that a branch must hold to be a layout of its own.
SUPPORT = 0.01
#: Lines of a block in which times are carried forward.
BLOCK = 4096
#: Share of a layout's lines that must show what a slot is said to hold.
SHOWN = 0.5

CLOCK = r"[\[(]?\d{1,3}(?::\d{1,2}){1,2}(?:[.,]\d+)?[\])]?"
_LEADING_CLOCK = rf"^\s*{CLOCK}(?=\s|$)"
_MARK = r"^\s*>>+\s*"
_LABEL = r"^\s*(?:>>+\s*)?([^:\[\](){}<>\n]+?):(?=\s|$)"
_ANNOTATION = r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>|【[^【】]*】|（[^（）]*）|\*[^*\s][^*]*\*|♪[^♪]*♪|[♪♫]"
#: Hesitation sounds: um, uh, uhm, er, erm, hm, hmm, mm, mhm, äh, ähm, öh, eh, ah and longer forms.
_HESITATION = r"u++h*+m*+|e++r*+h*+m*+|h++m++|m++(?:h++m++)?|[äöa]++h++m*+"
_LETTER = r"[\p{L}\p{N}]"
#: The start of a word that is no hesitation sound; hyphens part words.
_SPOKEN = rf"(?<!{_LETTER})(?<!{_LETTER}['’_.])(?!(?:{_HESITATION})(?!{_LETTER}|['’_.]{_LETTER})){_LETTER}"


def without_annotations(text: Column) -> Column:
    return F.when(text.rlike(r"[\[({<【（*♪♫]"), F.regexp_replace(text, _ANNOTATION, " ")).otherwise(text)


def has_speech(text: Column) -> Column:
    """The text has a word besides hesitation sounds and annotations."""
    return F.coalesce(F.lower(without_annotations(text)).rlike(_SPOKEN), F.lit(False))


def without_clock(text: Column) -> Column:
    return F.regexp_replace(text, _LEADING_CLOCK, "")


def clean_speech(text: Column) -> Column:
    """Speech without annotations, hesitation sounds and doubled space."""
    filler = rf"(?i)(?<![\p{{L}}\p{{N}}'’_.-])(?:{_HESITATION})(?:-(?:{_HESITATION}))*[.,…]*(?![\p{{L}}\p{{N}}'’_-])"
    plain = F.trim(F.regexp_replace(F.regexp_replace(without_annotations(text), filler, ""), r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(plain, r"\s+([,.;:!?…])", "$1"), r"^[ ,]+|[ ,]+$", "")


def masked(text: Column, depth: int = DEPTH) -> Column:
    """Path of a text in the token tree: its first tokens, with runs of digits as 0, of letters as A (all
    upper case), C (some) and a, and repeated marks once; it ends with a token that ends in a colon."""
    tokens = F.array_join(F.slice(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?U)\s+", depth + 1), 1, depth), " ")
    opened = F.coalesce(F.nullif(F.regexp_extract(tokens, r"^(?:\S+ )*?\S*:(?= |$)", 0), F.lit("")), tokens)
    shape = F.regexp_replace(opened, r"\d+", "0")
    shape = F.regexp_replace(F.regexp_replace(shape, r"\p{Lu}+", "\u0002"), r"[\p{L}\p{M}]+", "\u0001")
    shape = F.regexp_replace(shape, "(?:\u0001\u0002|\u0002\u0001)[\u0001\u0002]*+", "C")
    return F.translate(F.regexp_replace(shape, r"([^\w\s])\1+", "$1"), "\u0001\u0002", "aA")


def _plain(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).casefold().replace("co-host", "cohost")))


def spellings(cast: list[dict]) -> dict[tuple[str, ...], str | None]:
    """What a label may say for each of a cast; a spelling that several share means nobody."""
    known: dict[tuple[str, ...], str | None] = {}
    for member in cast:
        name, role = _plain(member["full_name"] or ""), _plain(member["role"] or "")
        if not name:
            continue
        first, last = name[:1], name[-1:]
        forms = {name, first, last, last + first, (first[0][0], last[0][0]), (first[0][0] + last[0][0],), (first[0][0], *last), (*first, last[0][0]), first + role, name + role, role, role + name, role + first}
        for form in forms - {()}:
            known[form] = member["speaker_id"] if known.get(form, member["speaker_id"]) == member["speaker_id"] else None
    return known


def _distance(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def named(label: str, known: dict[tuple[str, ...], str | None]) -> str | None:
    """The cast member that a label means. A misspelt name of five letters or more means the only one
    that is at most two letters away."""
    form = _plain(label)
    if not form:
        return None
    if form in known:
        return known[form]
    text = " ".join(form)
    if len(text) < 5 or len(form) > 3:
        return None
    most = 2 if len(form) > 1 else 1
    near = {person: d for k, person in known.items() if person and len(k) == len(form) and (d := _distance(text, " ".join(k), most)) <= most}
    return next(iter(near)) if len(near) == 1 else None


def _spellings(cast: pa.Array) -> pa.Array:
    """Map of what a label may say to the person, '' where several share it."""
    return pa.array([[(" ".join(form), person or "") for form, person in spellings(members or []).items()] for members in cast.to_pylist()], pa.map_(pa.string(), pa.string()))


def _persons(label: pa.Array, known: pa.Array) -> pa.Array:
    """The cast member that each label means by :func:`named`; null labels mean nobody."""
    persons = []
    for text, forms in zip(label.to_pylist(), known.to_pylist()):
        persons.append(None if text is None else named(text, {tuple(form.split()): person or None for form, person in forms}))
    return pa.array(persons, pa.string())


def stamp_layout(stamp: Column) -> Column:
    """Layout of a stamp: lower case, without brackets around it and space, numbers as 0."""
    return F.regexp_replace(_bare_stamp(stamp), r"\d+(?:\.\d+)?", "0")


def _bare_stamp(stamp: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(stamp)), r"^[\[(<{]\s*|\s*[\])>}]$|\s", ""), F.lit(","), F.lit("."))


def stamp_numbers(stamp: Column) -> Column:
    return F.transform(F.regexp_extract_all(_bare_stamp(stamp), F.lit(r"\d+(?:\.\d+)?"), 0), lambda n: n.try_cast("double"))


def stamp_slots(layout: Column) -> Column:
    """Seconds that each number of a layout counts for: ``h:m:s``, ``m:s`` or seconds, or numbers with units;
    null if it is no clock."""
    parts = F.split(layout, ":")
    by_colon = F.when(layout.rlike(r"^0(:0){0,2}$"), F.slice(F.array(F.lit(3600.0), F.lit(60.0), F.lit(1.0)), -F.size(parts), F.size(parts)))
    units = F.array(*[F.when(layout.contains(f"0{unit}"), F.lit(seconds)) for unit, seconds in (("h", 3600.0), ("m", 60.0), ("s", 1.0))])
    by_unit = F.when(layout.rlike(r"^(0h)?(0m(in)?)?(0s(ec)?)?$") & (layout != ""), F.array_compact(units))
    return F.coalesce(by_colon, by_unit)


def _dot(numbers: Column, slots: Column) -> Column:
    """Seconds of the numbers in the slots; null without slots."""
    return F.aggregate(F.zip_with(numbers, slots, lambda n, s: F.coalesce(n, F.lit(0.0)) * s), F.lit(0.0), lambda a, x: a + x)


def clock_seconds(text: Column) -> Column:
    """Seconds of a clock by the slots that its own marks show; null if it is none."""
    return _dot(stamp_numbers(text), stamp_slots(stamp_layout(text)))


def read_lines(lines: DataFrame, cast: DataFrame, speakers: DataFrame, with_text: bool = True) -> DataFrame:
    """Distinct lines with what their stamp, label and text say, written to the shared folder.

    ``stamp`` (layout) and ``numbers``; ``label`` (lettered, of the column ``speaker``) and ``head`` (before
    the first colon of the text within the depth of the tree) and whom of the cast they mean (``labelled``,
    ``headed``); ``path`` of the text and whether it opens with a clock (``clocked``); and whether the
    text is speech as it is, without its clock, and behind its head. Texts themselves only if asked for.
    """
    # One step per column that others use, so that each pattern runs once a line.
    text, plain, rest = F.col("text"), F.col("plain"), F.col("rest")
    steps = lines.select(F.col("doc_id").cast("bigint"), F.col("line_no").cast("int"), "timestamp", "speaker", "text").dropna(subset=["doc_id", "line_no"])
    steps = steps.withColumn("clocked", F.coalesce(text.rlike(_LEADING_CLOCK), F.lit(False)))
    steps = steps.withColumns({"plain": F.when(F.col("clocked"), without_clock(text)).otherwise(text), "speech": has_speech(text)})
    steps = steps.withColumn("at_colon", F.when(F.contains(plain, F.lit(":")), F.regexp_extract(plain, _LABEL, 0)).otherwise(""))
    within = (F.col("at_colon") != "") & (F.size(F.split(F.trim("at_colon"), r"(?U)\s+")) <= DEPTH)
    steps = steps.withColumn("rest", F.when(within, F.substr(plain, F.length("at_colon") + 1)))
    narrow = steps.select(
        "doc_id", "line_no", stamp_layout(F.col("timestamp")).alias("stamp"), stamp_numbers(F.col("timestamp")).alias("numbers"),
        F.when(F.col("speaker").rlike(r"\p{L}"), F.col("speaker")).alias("label"), F.when(rest.isNotNull(), F.regexp_extract("at_colon", _LABEL, 1)).alias("head"),
        masked(text).alias("path"), "clocked", "speech", F.when(F.col("clocked"), has_speech(plain)).otherwise(F.col("speech")).alias("plain_speech"),
        F.when(rest.isNotNull(), has_speech(rest)).otherwise(False).alias("rest_speech"), *(["text", "rest"] if with_text else []),
    )
    once = stored(narrow.distinct())
    labels = once.select("doc_id", "line_no", F.explode(F.array_compact(F.array("label", "head"))).alias("label"))
    pairs = labels.groupBy("doc_id", "label").agg(F.max("line_no").alias("last"))
    members = F.array_sort(F.collect_set(F.struct("speaker_id", "full_name", "role")))
    casts = cast.join(speakers.select("speaker_id", "full_name"), "speaker_id").groupBy("doc_id").agg(members.alias("cast"))
    known = casts.select("doc_id", F.arrow_udf(_spellings, T.MapType(T.StringType(), T.StringType()))("cast").alias("known"))
    form = F.trim(F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}]+", " "))
    asked = pairs.join(known, "doc_id").withColumn("exact", F.col("known")[form])
    # Python sees only labels that nobody is spelled like.
    unknown = F.col("exact").isNull() & (F.size(F.split(form, " ")) <= 3)
    near = F.arrow_udf(_persons, T.StringType())(F.when(unknown, F.col("label")), F.when(unknown, F.col("known")))
    resolved = asked.withColumn("person", F.nullif(F.coalesce("exact", near), F.lit(""))).filter("person is not null")
    persons = stored(resolved.select("doc_id", "label", "person", "last"))
    spoken = block_join(once, persons.withColumnRenamed("person", "labelled"), ["doc_id", "label"], F.col("line_no"), "last")
    headed = persons.select("doc_id", F.col("label").alias("head"), F.col("person").alias("headed"), "last")
    return block_join(spoken, headed, ["doc_id", "head"], F.col("line_no"), "last")


def mined_layouts(paths: DataFrame, support: float = SUPPORT, depth: int = DEPTH) -> DataFrame:
    """``path`` and its ``layout``: the path down to the first branch that holds less than ``support`` of its
    parent's lines, and a wildcard (with the colon if the path ends in one) for the rest. A clock is kept
    before the wildcard, however rare its branch.

    ``paths`` has distinct ``path`` with ``n`` lines; only counts of tree nodes are shuffled.
    """
    split = F.split("path", " ")
    node = F.explode(F.transform(F.sequence(F.lit(1), F.size(split)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(split, 1, i), " ").alias("node"), F.array_join(F.slice(split, 1, i - 1), " ").alias("parent"))))
    nodes = paths.select("path", "n", node.alias("v")).select("path", "n", "v.*")
    below = nodes.groupBy("level", "node", "parent").agg(F.sum("n").alias("n_node"))
    parents = nodes.groupBy("level", "parent").agg(F.sum("n").alias("n_parent"))
    weak = below.join(parents, ["level", "parent"]).filter(F.col("n_node") < support * F.col("n_parent")).select("level", "node")
    cut_at = nodes.join(weak, ["level", "node"]).groupBy("path").agg(F.min("level").alias("weak"))
    clock = F.get(split, F.col("weak") - 1).rlike(r"^[\[(]?0(:0){1,2}([.,]0)?[\])]?$")
    kept = F.array_join(F.slice(split, 1, F.col("weak") - F.when(clock, 0).otherwise(1)), " ")
    wild = F.when(F.col("path").endswith(":"), "*:").otherwise("*")
    layout = F.when(F.col("weak").isNull(), F.col("path")).otherwise(F.trim(F.concat_ws(" ", kept, wild)))
    return paths.join(cut_at, "path", "left").select("path", layout.alias("layout"))


def line_layouts(read: DataFrame, share: float = SHOWN, support: float = SUPPORT) -> DataFrame:
    """Mined layouts of texts by path, written to the shared folder: ``path``, ``layout``, ``n_lines`` of the layout, and whether it has a
    ``clock_slot`` and a ``speaker_slot``."""
    paths = cut(
        read.groupBy("path").agg(
            F.count("*").alias("n"), F.count_if("clocked").alias("n_clocked"), F.count("head").alias("n_heads"), F.count("headed").alias("n_named")
        )
    )
    mined = paths.join(mined_layouts(paths.select("path", "n"), support), "path")
    sums = mined.groupBy("layout").agg(*[F.sum(c).alias(f"sum_{c}") for c in ("n", "n_clocked", "n_heads", "n_named")])
    slots = sums.select(
        "layout", F.col("sum_n").alias("n_lines"), (F.col("sum_n_clocked") >= share * F.col("sum_n")).alias("clock_slot"),
        ((F.col("sum_n_heads") > 0) & (F.col("sum_n_named") >= share * F.col("sum_n_heads"))).alias("speaker_slot"),
    )
    return stored(mined.select("path", "layout").join(slots, "layout"))


def stamp_layouts(read: DataFrame, share: float = SHOWN) -> DataFrame:
    """Mined layouts of stamps: ``stamp``, ``n_lines`` and ``slots`` (null if it is no clock, or if its minutes
    and seconds mostly exceed sixty)."""
    minor = F.forall(F.slice("numbers", F.lit(2), F.greatest(F.size("numbers") - 1, F.lit(0))), lambda n: n < 60)
    counted = read.filter("stamp is not null").groupBy("stamp").agg(F.count("*").alias("n_lines"), F.count_if(minor).alias("n_sound"))
    slots = F.when(F.col("n_sound") >= share * F.col("n_lines"), stamp_slots(F.col("stamp")))
    return stored(counted.select("stamp", "n_lines", slots.alias("slots")))


def apply_layouts(read: DataFrame, layouts: DataFrame, stamps: DataFrame) -> DataFrame:
    """Lines with ``seconds``, whether they are ``spoken``, the ``person`` (null where no label tells it) and,
    with texts, what is ``said`` and the ``shown`` seconds (of the stamp, else of a clock in the text)."""
    row = F.struct("doc_id", "line_no")
    slots = salted_join(read, layouts.select("path", "clock_slot", "speaker_slot"), ["path"], row)
    timed = salted_join(slots, stamps.select("stamp", "slots"), ["stamp"], row)
    in_head = F.coalesce("speaker_slot", F.lit(False)) & F.col("head").isNotNull()
    at_clock = F.coalesce("clock_slot", F.lit(False))
    seconds = _dot(F.col("numbers"), F.col("slots"))
    spoken = F.when(in_head, F.col("rest_speech")).when(at_clock, F.col("plain_speech")).otherwise(F.col("speech"))
    texts = []
    if "text" in read.columns:
        texts = [
            F.when(in_head, F.col("rest")).when(at_clock, without_clock(F.col("text"))).otherwise(F.col("text")).alias("said"),
            F.coalesce(seconds, F.when(at_clock, clock_seconds(F.regexp_extract("text", _LEADING_CLOCK, 0)))).alias("shown"),
        ]
    person = F.when(F.col("label").isNotNull(), F.col("labelled")).otherwise(F.when(in_head, F.col("headed")))
    return timed.select("doc_id", "line_no", seconds.alias("seconds"), spoken.alias("spoken"), person.alias("person"), *texts)


def carry_times(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lines with ``at`` and ``at_line``: time and number of the last line up to each that has a time."""
    own = F.when(F.col("seconds").isNotNull(), F.struct(F.col("seconds").alias("at"), F.col("line_no").alias("at_line")))
    blocks = lines.withColumn("block", F.floor(F.col("line_no") / block)).withColumn("own", own)
    # a block has few lines, so its key needs no salt
    inside = Window.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = blocks.withColumn("in_block", F.last("own", ignorenulls=True).over(inside))
    ends = blocks.groupBy("doc_id", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("line_no"))).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("doc_id", "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    time = F.coalesce("in_block", "carried")
    return filled.join(carried, ["doc_id", "block"], "left").select(
        *lines.columns, F.coalesce(time["at"], F.lit(float("-inf"))).alias("at"), F.coalesce(time["at_line"], F.lit(-(2**31))).alias("at_line")
    )


RUNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("run", T.IntegerType()),
        T.StructField("person", T.StringType()),
        T.StructField("open", T.BooleanType()),
        T.StructField("first_line", T.IntegerType()),
        T.StructField("last_line", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("said", T.StringType()),
    ]
)
_RUNS = pa.schema(
    [("doc_id", pa.int64()), ("chunk", pa.int32()), ("run", pa.int32()), ("person", pa.string()), ("open", pa.bool_()),
     ("first_line", pa.int32()), ("last_line", pa.int32()), ("seconds", pa.float64()), ("said", pa.string())]
)


def _encode_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one person in a sorted chunk, numbered per recording; ``open`` is a run at the start of a
    recording's lines here that no label tells the person of."""
    chunk, current = TaskContext.get().partitionId(), None
    said: list[str] = []
    for batch in batches:
        out = []
        for doc_id, line_no, seconds, person, speech in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "line_no", "seconds", "person", "said"))):
            same = current is not None and current["doc_id"] == doc_id
            if same and (person is None or person == current["person"]):
                current["last_line"] = line_no
                said.append(speech or "")
                continue
            if current is not None:
                out.append(current | {"said": " ".join(said)})
            said = [speech or ""]
            current = {
                "doc_id": doc_id, "chunk": chunk, "run": current["run"] + 1 if same else 1, "person": person, "open": not same and person is None,
                "first_line": line_no, "last_line": line_no, "seconds": seconds,
            }
        if out:
            yield pa.RecordBatch.from_pylist(out, _RUNS)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current | {"said": " ".join(said)}], _RUNS)


def merge_turns(spoken: DataFrame, chunks: int | None = None) -> DataFrame:
    """Turns of speech lines (``doc_id``, ``line_no``, ``person``, ``at``, ``at_line``; with texts ``said`` and the
    ``shown`` seconds)."""
    keys = ["doc_id", "at", "at_line", "line_no"]
    with_text = "said" in spoken.columns
    own = [F.col("shown").alias("seconds"), clean_speech(F.col("said")).alias("said")] if with_text else [F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("string").alias("said")]
    lines = spoken.select(*keys, "person", *own)
    ranged = lines.repartitionByRange(chunks, *keys) if chunks else lines.repartitionByRange(*keys)
    runs = cut(ranged.sortWithinPartitions(*keys).mapInArrow(_encode_chunk, RUNS))

    second = F.max(F.when(F.col("run") == 2, F.col("person")))
    summary = runs.groupBy("doc_id", "chunk").agg(
        F.max("run").alias("n_runs"), F.bool_or("open").alias("open"), F.max(F.when(F.col("run") == 1, F.col("person"))).alias("first"), second.alias("second"),
        F.max_by("person", "run").alias("last"),
    )
    along = Window.partitionBy("doc_id").orderBy("chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summary.withColumn("carried", F.last("last", ignorenulls=True).over(before))
        .withColumn("follows", F.lag("chunk").over(along).isNotNull())
        .withColumn("joins", (F.col("follows") & (F.col("open") | F.col("first").eqNullSafe(F.col("carried")))).cast("int"))
        .withColumn("joins", F.col("joins") + (F.col("follows") & F.col("open") & (F.coalesce(F.col("second") == F.col("carried"), F.lit(False)))).cast("int"))
        .withColumn("before", F.coalesce(F.sum(F.col("n_runs") - F.col("joins")).over(before), F.lit(0)))
        .select("doc_id", "chunk", "carried", "joins", "before", F.col("n_runs").alias("last_run"))
    )
    numbered = block_join(runs, carried, ["doc_id", "chunk"], F.col("run"), "last_run").select(
        "doc_id",
        F.greatest(F.col("before") + F.col("run") - F.col("joins"), F.col("before")).cast("int").alias("turn_no"),
        F.when(F.col("open"), F.col("carried")).otherwise(F.col("person")).alias("speaker_id"),
        F.struct("chunk", "run").alias("at"), "first_line", "last_line", "seconds", "said",
    )
    texts = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda r: r["said"]), lambda s: s != ""), " ")
    return numbered.groupBy("doc_id", "turn_no").agg(
        F.min_by("speaker_id", "at").alias("speaker_id"),
        F.min_by("first_line", "at").alias("first_line"),
        F.max_by("last_line", "at").alias("last_line"),
        *([F.min_by("seconds", "at").alias("seconds"), texts.alias("text")] if with_text else []),
    )


def speaker_turns(lines: DataFrame, cast: DataFrame, speakers: DataFrame, chunks: int | None = None, with_text: bool = True) -> DataFrame:
    """Turns of all recordings: ``doc_id``, ``turn_no``, ``speaker_id``, ``first_line``, ``last_line`` and, with
    texts, ``seconds`` (of the first line, else of the clock its text opens with) and clean ``text``."""
    read = stored(read_lines(lines, cast, speakers, with_text))
    said = apply_layouts(read, line_layouts(read), stamp_layouts(read))
    return merge_turns(carry_times(said).filter("spoken"), chunks)
