"""Line deduplication across a corpus by a segment-partition edit join, in DataFrame operations only.

A line with a word is removed if an equal line, or a similar one, stands earlier in the order of (doc_id, line
number); the first one stays. Lines are similar within ``threshold`` edits that are at most a share of
1 - ``similarity`` of the longer line's characters (with two edits and 0.8: one edit from 5 characters on, two from 10 on).

Equal lines meet on 128 bits of hashes, aggregated before the shuffle. For edits, a line is cut into
threshold+1 even segments (fewer if it's so short that fewer edits are similar): of so many edits at least one segment is
untouched. Every distinct line puts its segments into an index keyed by (length, segment number, content), and probes, for each
length within the threshold, the substrings at which a segment of such a line can lie if the segments before
it took at least as many edits as their number less one (multi-match selection). Lines that meet
another are read again and get a signature, 64 parities of their character pairs: an edit changes at
most four, so pairs that differ in more than 4*threshold are passed over. The others are verified with a banded
bit-parallel edit distance: a word of 2*threshold+1 bits for each number of edits holds the reached cells of the band
in one column of the table, and a column takes a few shifts and ands.

Only whether a line has an earlier similar one is asked, so its pairs aren't listed: first each line is held against the
earliest line of the other side at each of its keys, in time linear in the entries; only lines that this
doesn't settle (in a group of near copies, one) are held against all earlier ones. A key that very many lines
share (``hot_rows``) is dealt anew then by the 4*threshold+1 blocks of the signatures, one of which agrees where at most
4*threshold bits differ. No line is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialize

THRESHOLD = 2
SIMILARITY = 0.8
HOT_ROWS = 256
#: Rows of a table of ids up to which it's broadcast: 8 bytes each, under 2 MB.
BROADCAST_IDS = 200_000
BLANK = " \t\n\x0b\x0c\r"
HAS_WORD = "[^\\x20\\x09-\\x0D]"
SLACK = 1e-9


def _lines(docs: DataFrame) -> DataFrame:
    """(row, line_no, line) of all lines with a word."""
    split = docs.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.where(F.trim("line", F.lit(BLANK)) != "")


def _allowed(longer: Column, threshold: int, similarity: float) -> Column:
    """The edits that are similar in a pair whose longer line has so many characters."""
    return F.least(F.lit(threshold), F.floor(longer * (1 - similarity) + SLACK).cast("int"))


def _reach(length: Column, threshold: int, similarity: float) -> Column:
    """The most edits in which a line is similar to one of its length or longer: d <= (1 - similarity) * (length + d)."""
    return F.greatest(F.lit(0), F.least(F.lit(threshold), F.floor(length * ((1 - similarity) / similarity) + SLACK).cast("int")))


def _with_keys(lines: DataFrame, threshold: int, similarity: float) -> DataFrame:
    """``lines`` (line, ...) with ``index_keys`` and ``probe_keys``; null keys stand for those that a short line hasn't.

    Segments are even, the last ones longer; a line that is similar to others in fewer edits than the threshold has
    fewer. A line probes for others that are as long or shorter by up to the threshold. What is used often is a column of its own."""
    lines = lines.withColumn("_n0", F.char_length("line")).withColumns({f"_n{less}": F.col("_n0") - less for less in range(1, threshold + 1)})
    lines = lines.withColumns({f"_e{less}": _reach(F.col(f"_n{less}"), threshold, similarity) for less in range(threshold + 1)})
    whole = lambda a, b: F.call_function("div", a, b).cast("int")
    lines = lines.withColumns({f"_s{less}": whole(F.col(f"_n{less}"), F.col(f"_e{less}") + 1) for less in range(threshold + 1)})
    # the number of the first longer segment
    lines = lines.withColumns({f"_m{less}": F.col(f"_e{less}") + 1 - (F.col(f"_n{less}") - F.col(f"_s{less}") * (F.col(f"_e{less}") + 1)) for less in range(threshold + 1)})

    def key(less: int, i: int, shift: int) -> Column:
        length, edits, size, longer = (F.col(f"_{c}{less}") for c in "nesm")
        start, own = size * i + F.greatest(F.lit(0), F.lit(i) - longer), size + F.when(longer <= i, 1).otherwise(0)
        there = (edits >= max(i, less, 1)) & (size > 0)
        return F.when(there, F.xxhash64(length, F.lit(i), F.substring("line", start + (shift + 1), own)))

    index = [key(0, i, 0) for i in range(threshold + 1)]
    # at most i edits before the segment, at most threshold-i behind it: the shift lies in both ranges
    shifts = lambda less, i: range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1)
    probe = [key(less, i, shift) for less in range(threshold + 1) for i in range(threshold + 1) for shift in shifts(less, i)]
    return lines.withColumns({"index_keys": F.array(*index), "probe_keys": F.array(*probe)}).drop(*[f"_{c}{less}" for c in "nesm" for less in range(threshold + 1)])


def _signature(chars: Column) -> Column:
    """Parity of the pairs of neighbouring characters by 64 classes; an edit changes at most four bits.

    ``chars`` must be a column of its own: an expression would be worked out again for every character."""
    pairs = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0)))
    bits = F.transform(pairs, lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.get(chars, i + 1)), F.lit(64)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def _blocks(signature: Column, threshold: int) -> Column:
    """Structs (number, bits) of the 4*threshold+1 blocks of a signature."""
    n = 4 * threshold + 1
    edges = [64 * i // n for i in range(n + 1)]
    parts = [F.shiftrightunsigned(signature, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("number"), p.alias("bits")) for i, p in enumerate(parts)]))


def edit_distance(rows: DataFrame, one: str, two: str, threshold: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the edit distance of the arrays of characters ``one`` and ``two``, null beyond the threshold.

    Bit k of word e says that cell (i, j) of the table, i = j + k - threshold, is reached with at most e edits. From one
    column to the next a match keeps k, a substitution too with one edit more, an insertion moves to k-1, a deletion
    within the column to k+1."""
    width, zero = 2 * threshold + 1, F.lit(0).cast("long")
    window = lambda c, j: sum((F.when(F.get(one, j + (k - threshold)) == c, F.lit(1 << k).cast("long")).otherwise(zero) for k in range(width)), zero)
    start = F.struct(*[F.lit(sum(1 << k for k in range(threshold, threshold + e + 1)) & ((1 << width) - 1)).cast("long").alias(f"r{e}") for e in range(threshold + 1)])

    def column(state: Column, match: Column) -> Column:
        new = [state.r0.bitwiseAND(match)]
        for e in range(1, threshold + 1):
            old, more = state[f"r{e}"], state[f"r{e - 1}"]
            cells = old.bitwiseAND(match).bitwiseOR(more).bitwiseOR(F.shiftright(more, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(cells.bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(new)])

    rows = rows.withColumn("_masks", F.transform(two, window)).withColumn("_end", F.size(one) - F.size(two) + threshold)
    rows = rows.withColumn("_cells", F.aggregate("_masks", start, column))
    reached = lambda e: F.call_function("shiftright", F.col(f"_cells.r{e}"), F.col("_end")).bitwiseAND(F.lit(1).cast("long")) == 1
    found = F.coalesce(*[F.when(F.col("_end").between(0, width - 1) & reached(e), F.lit(e)) for e in range(threshold + 1)])
    return rows.withColumn(out, found).drop("_masks", "_end", "_cells")


def _few(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if it's small, by count."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _texts_of(asked: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """``(h, row, line_no, line)`` of the lines with these hashes ``h``, read again from where they stand first."""
    where = lines.join(_few(asked), "h", "left_semi").select("row", "line_no")
    return texts.join(_few(where), ["row", "line_no"], "left_semi").select("h", "row", "line_no", "line")


def late_lines(lines: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, similarity: float = SIMILARITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(h)``: hashes of the lines that are similar to an earlier, different one, once.

    ``lines``: the distinct lines (h, row, line_no, index_keys, probe_keys), standing first at (row, line_no).
    ``texts``: (row, line_no, h, line).
    """
    entries = lambda keys, probes: lines.select("h", F.explode(keys).alias("key"), F.lit(probes).alias("probes")).where("key is not null")
    emitted = entries("index_keys", False).unionByName(entries("probe_keys", True))
    # first the keys at which different lines meet: a sum for each key, whatever its number of lines is; only these are looked at
    own = F.sum(F.when(F.col("probes"), 0).otherwise(1)).alias("n")
    keys = emitted.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most"), own).where("least <> most and n > 0").select("key", "n")
    keys = materialize(keys, "keys")
    live = materialize(emitted.join(_few(keys.select("key")), "key", "left_semi"), "live")
    read = _texts_of(live.select("h").distinct(), lines, texts).withColumn("chars", F.split("line", ""))
    found = materialize(read.select("h", F.struct("row", "line_no").alias("at"), "chars", _signature(F.col("chars")).alias("s")), "found")
    signed = materialize(live.join(found.select("h", "at", "s"), "h").select("key", "probes", "h", "at", "s"), "signed")
    close = lambda s, t: F.bit_count(s.bitwiseXOR(t)) <= 4 * threshold

    def verified(pairs: DataFrame) -> DataFrame:
        """Those lines ``h`` of the pairs (h, other) that are similar to the other."""
        one, two = found.select("h", F.col("chars").alias("one")), found.select(F.col("h").alias("other"), F.col("chars").alias("two"))
        rows = edit_distance(pairs.distinct().join(one, "h").join(two, "other"), "one", "two", threshold, "edits")
        return rows.where(F.col("edits") <= _allowed(F.greatest(F.size("one"), F.size("two")), threshold, similarity)).select("h").distinct()

    entry = F.struct("at", "h", "s")
    first = signed.groupBy("key").agg(F.min(F.when(~F.col("probes"), entry)).alias("held"), F.min(F.when(F.col("probes"), entry)).alias("asking"))
    across = signed.join(first, "key").withColumn("o", F.when(F.col("probes"), F.col("held")).otherwise(F.col("asking")))
    across = across.where((F.col("o.at") < F.col("at")) & (F.col("o.h") != F.col("h")) & close(F.col("s"), F.col("o.s")))
    settled = materialize(verified(across.select("h", F.col("o.h").alias("other"))), "settled")
    unsettled = signed.join(_few(settled), "h", "left_anti")

    def earlier(later: DataFrame, all_: DataFrame, on: list[str]) -> DataFrame:
        them = all_.select(*on, *[F.col(c).alias(f"o_{c}") for c in ("probes", "h", "at", "s")])
        rows = later.join(them, on).where((F.col("probes") != F.col("o_probes")) & (F.col("o_at") < F.col("at")) & (F.col("h") != F.col("o_h")) & close(F.col("s"), F.col("o_s")))
        return rows.select("h", F.col("o_h").alias("other"))

    hot = keys.where(F.col("n") > hot_rows).select("key")
    if hot.isEmpty():
        pairs = earlier(unsettled, signed, ["key"])
    else:
        many, block = _few(hot), _blocks(F.col("s"), threshold).alias("block")
        pairs = earlier(unsettled.join(many, "key", "left_anti"), signed.join(many, "key", "left_anti"), ["key"])
        pairs = pairs.unionByName(earlier(unsettled.join(many, "key", "left_semi").select("*", block), signed.join(many, "key", "left_semi").select("*", block), ["key", "block"]))
    return settled.unionByName(verified(pairs))


def decide(docs: DataFrame, threshold: int = THRESHOLD, similarity: float = SIMILARITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(row, repeated, similar)``: the numbers of the lines to remove from each row of ``docs`` (row, text) that has such lines."""
    lines = _lines(docs).withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))
    told = _with_keys(lines, threshold, similarity)
    first = F.min(F.struct("row", "line_no", "index_keys", "probe_keys"))
    distinct = materialize(told.groupBy("h", "h2").agg(first.alias("first"), F.count("*").alias("n")).select("h", "h2", "n", "first.*"), "lines")
    late = materialize(late_lines(distinct, lines.select("row", "line_no", "h", "line"), threshold, similarity, hot_rows), "late")
    # lines that are more than one, or late: all others stay and aren't looked up
    marked = distinct.select("h", "h2", "n", "row", "line_no").join(late.withColumn("late", F.lit(True)), "h", "left").where("n > 1 or late")
    marked = marked.select("h", "h2", F.struct("row", "line_no").alias("first"), F.coalesce("late", F.lit(False)).alias("late"))
    gone = lines.select("h", "h2", "row", "line_no").join(marked, ["h", "h2"]).withColumn("again", F.struct("row", "line_no") != F.col("first")).where("again or late")
    some = gone.groupBy("row").agg(F.collect_list(F.when(F.col("again"), F.col("line_no"))).alias("repeated"), F.collect_list(F.when(~F.col("again"), F.col("line_no"))).alias("similar"))
    return some


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, similarity: float = SIMILARITY, hot_rows: int = HOT_ROWS, counts: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` without its repeated and similar lines, and three more columns:
    ``n_lines`` (with a word), ``n_repeated``, ``n_similar`` (removed ones).

    A line is similar if it isn't equal to an earlier one but within ``threshold`` edits of one, at most a share of
    1 - ``similarity`` of the longer one's characters; that earlier line counts whether or not it is itself
    removed. So lines under 4 characters are only ever equal. Blank lines always stay. Order is by doc_id, then by a hash of the text for rows with one doc_id
    (null ids come first). Null texts stay null with zero counts; a text whose lines all go becomes empty;
    an empty table gives no rows. Without ``counts`` the columns are those of ``docs``; with them, columns of ``docs`` that
    are named like a count are left out. Names that clash with working columns are kept apart.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    ids, text = F.col("doc.doc_id").cast("long"), F.col("doc.text").cast("string")
    # a row is told by its id and its text's hash; rows equal in both are one for the decision
    keyed = kept.select("doc", F.struct(ids.alias("id"), F.xxhash64(text).alias("hash")).alias("row"), text.alias("text"))
    left = keyed.join(decide(keyed.select("row", "text"), threshold, similarity, hot_rows), "row", "left")
    lines = F.split("text", "\n", -1)
    drop = F.concat("repeated", "similar")
    new = F.when(F.col("repeated").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n"))
    n_lines = F.size(F.filter(lines, lambda x: F.trim(x, F.lit(BLANK)) != ""))
    made = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")} if counts else {}
    for c in ("repeated", "similar") if counts else ():
        made[f"n_{c}"] = F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    fields = [new.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in made]
    return left.select(*fields, *[c.alias(name) for name, c in made.items()])
