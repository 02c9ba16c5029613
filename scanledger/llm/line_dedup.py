"""Line dedup: a segment-partition edit join over the distinct lines of all documents, in built-in functions only.

Two lines link when at most ``EDITS`` insertions, deletions and substitutions turn one into the other.  Every line is
split into ``EDITS`` + 1 segments of even length; within that distance one segment of the shorter line stands unchanged
in the longer, at a place that the two lengths confine.  Segments are indexed by number and content, and substrings of
each line are probed at those places only, each once for all lengths of a partner that it serves.  Candidates must agree
in a parity sketch of their character pairs (an edit changes at most four pairs) and are verified by banded bit-parallel
edit distance: one bit per diagonal, one word per number of edits.  A line is verified with one pivot of each bucket
first, and after that only with lines of other classes than the one it belongs to so far.  Linked lines form classes; of
each class the first line (by doc_id, line) stays.

Lines of ``least`` to ``SHORTEST`` - 1 characters, where a caller names ``least``, take part by equality alone: two edits
make almost any short line of another.

Defined results: lines shorter than ``least`` characters (``SHORTEST`` where it isn't named) and blank lines under
``SHORTEST`` characters stay; a null text has no lines and stays null; an empty text has one empty line; rows with the same
doc_id share their decisions; rows without a doc_id keep all their lines and cost others nothing; ties do not arise (places
are distinct); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, may_hold, pick, settle, without

EDITS = 2
SHORTEST = 20
#: What the registered query and the pipeline name as ``least``: all lines that aren't blank take part.
LEAST = 1
#: Lines found more often than this are sent once from where they stand first, and not from each place.
OFTEN = 16


def lines_of(docs: DataFrame, shortest: int = SHORTEST, least: int | None = None) -> DataFrame:
    """doc_id, line_no, line, n, id of the lines of (doc_id, text) that are long enough; equal lines have equal ids (64-bit hashes)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    enough = F.length("line") >= shortest
    if least is not None and least < shortest:
        enough = enough | ((F.length("line") >= least) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.where(enough).select("doc_id", "line_no", "line", F.length("line").alias("n"), F.xxhash64("line").alias("id"))


def _segment(n: int, i: int, parts: int) -> tuple[int, int]:
    """Start (from 1) and length of segment i (from 0) of a line of length n; longer segments come last."""
    short, longer = divmod(n, parts)  # so many segments at the end have one more
    return short * i + max(i - (parts - longer), 0) + 1, short + (i >= parts - longer)


def substrings(remainder: int, edits: int = EDITS) -> list[tuple[int, int, int, bool]]:
    """(i, start, size, indexed) of all substrings of a line of length k * (edits + 1) + remainder, without repeats.

    Start is less i * k, size less k, so that one list holds for every k.  Segments of the line itself are indexed; a
    partner shorter by ``less`` may have its segment i anywhere from ``less - (edits - i)`` to ``less + (edits - i)``, and
    from -i to i, characters away.
    """
    parts, k = edits + 1, edits + 1  # any k that leaves all segments some characters
    n, found = k * parts + remainder, {}
    for i in range(parts):
        start, size = _segment(n, i, parts)
        found[i, start - i * k, size - k] = True
    for less in range(parts):
        for i in range(parts):
            start, size = _segment(n - less, i, parts)
            for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                found.setdefault((i, start + move - i * k, size - k), False)
    return [(*place, indexed) for place, indexed in found.items()]


def segment_rows(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """hash, id, n, probe of every indexed segment (probe false) and every other probed substring (true) of ``lines``.

    Lengths are left out of the hash: one substring stands for all lengths of a partner that it may be a segment of.
    """
    parts = edits + 1
    lists = [F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(not own).alias("probe")) for i, a, b, own in substrings(r, edits)]) for r in range(parts)]
    k = F.floor(F.col("n") / parts).cast("int")
    rows = lines.select("id", "n", "line", k.alias("k"), F.explode(F.get(F.array(*lists), F.col("n") % parts)).alias("s"))
    piece = F.col("line").substr(F.col("s.i") * F.col("k") + F.col("s.a"), F.col("k") + F.col("s.b"))
    return rows.select(F.xxhash64("s.i", piece).alias("hash"), "id", "n", "s.probe")


def pair_parity(letters: str) -> Column:
    """64 parities of the counts of hashed neighbouring pairs in an array of characters."""
    c = F.col(letters)
    steps = F.sequence(F.lit(0), F.size(c) - 2)
    one = F.lit(1).cast("long")
    flip = lambda i: F.call_function("shiftleft", one, F.pmod(F.xxhash64(F.get(c, i), F.get(c, i + 1)), F.lit(64)).cast("int"))
    return F.when(F.size(c) >= 2, F.aggregate(steps, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseXOR(flip(i)))).otherwise(F.lit(0).cast("long"))


def within(pairs: DataFrame, a: str, b: str, edits: int = EDITS) -> DataFrame:
    """Those of ``pairs`` whose arrays of characters ``a`` and ``b`` are at most ``edits`` edits apart.

    Bit d + edits of the word for e edits says whether the first i characters of a and the first i + d of b can be
    matched with at most e edits.  One character of a is read at a time; the masks of matching diagonals come first.
    """
    names, wide = pairs.columns, 2 * edits + 1
    x, y = F.col(a), F.col(b)
    bit = lambda i, d: F.when(F.get(x, i) == F.get(y, i + d), F.lit(1 << (d + edits))).otherwise(0)
    mask = F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: sum((bit(i, d) for d in range(1 - edits, edits + 1)), bit(i, -edits)))
    pairs = pairs.select(*names, F.when(F.size(x) > 0, mask).otherwise(F.array().cast("array<int>")).alias("_masks"))
    first = [1 << edits]
    for _ in range(edits):
        first.append(first[-1] | first[-1] << 1)
    full = (1 << wide) - 1
    left = lambda c: F.call_function("shiftleft", c, F.lit(1)).bitwiseAND(F.lit(full))
    right = lambda c: F.call_function("shiftright", c, F.lit(1))

    def step(acc: Column, m: Column) -> Column:
        words = [acc["r0"].bitwiseAND(m)]
        for e in range(1, edits + 1):
            old = acc[f"r{e - 1}"]
            words.append(acc[f"r{e}"].bitwiseAND(m).bitwiseOR(old).bitwiseOR(right(old)).bitwiseOR(left(words[-1])))
        return F.struct(*[w.alias(f"r{e}") for e, w in enumerate(words)])

    start = F.struct(*[F.lit(v & full).alias(f"r{e}") for e, v in enumerate(first)])
    pairs = pairs.select(*names, F.aggregate("_masks", start, step, lambda acc: acc[f"r{edits}"]).alias("_last"), (F.size(y) - F.size(x) + edits).alias("_at"))
    return pairs.where(f"_at between 0 and {2 * edits} and getbit(_last, _at) = 1").select(*names)


def line_links(rows: DataFrame, firsts: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """a, b: ids of distinct lines at most ``edits`` apart (at least one path of links between any two that are)."""
    lines = lines_of(rows, shortest).select("id", "n", "line")
    often = firsts.where(F.col("hits") > OFTEN).select("id")
    once = may_hold(lines, "id", often).groupBy("id", "n").agg(F.min("line").alias("line"))
    parts = segment_rows(without(lines, "id", often).unionByName(once), edits)
    # Only hashes of two different lines, one of them indexed, matter.
    judged = parts.selectExpr("*", "min(id) over (partition by hash) <> max(id) over (partition by hash) and not min(probe) over (partition by hash) as shared")
    shared = settle(judged.where("shared").select("hash", "id", "n", "probe").distinct())

    wanted = shared.select("id").distinct()
    at = firsts.join(wanted, "id", "left_semi").select("first.doc_id", "first.line_no", "id")
    places = settle(at.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id")).alias("at")))
    texts = may_hold(rows, "doc_id", places.select("doc_id")).dropDuplicates(["doc_id"]).join(places.hint("merge"), "doc_id")
    texts = texts.select(F.split("text", "\n", -1).alias("lines"), F.explode("at").alias("p")).select(F.col("p.id").alias("id"), F.get("lines", F.col("p.line_no")).alias("line"))
    texts = texts.select("id", F.split("line", "").alias("letters"))
    texts = settle(texts.select("id", "letters", pair_parity("letters").alias("parity")))

    known = settle(shared.join(texts.select("id", "parity"), "id"))
    text_of = lambda s: texts.select(F.col("id").alias(s), F.col("letters").alias(f"letters_{s}"))
    verified = lambda pairs: settle(within(pairs.join(text_of("a"), "a").join(text_of("b"), "b"), "letters_a", "letters_b", edits).select("a", "b"))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    fits = f"bit_count(parity_a ^ parity_b) <= {4 * edits}"

    # Every line meets the first indexed one of each of its hashes; what links so is joined to classes.
    pivots = known.where("not probe").groupBy("hash").agg(F.min(F.struct("id", "n", "parity")).alias("pivot")).select("hash", F.col("pivot.id").alias("a"), F.col("pivot.n").alias("n_a"), F.col("pivot.parity").alias("parity_a"))
    stars = known.select("hash", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b")).join(pivots, "hash")
    stars = settle(stars.where(f"a <> b and abs(n_a - n_b) <= {edits} and {fits}").select(*pair).distinct())
    links = verified(stars)
    labels = components(links)

    # Only lines of different classes are paired, so a large group of lines that are alike costs no pair per pair of them.
    marked = known.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = marked.groupBy("hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("hash")
    marked = settle(marked.join(mixed, "hash", "left_semi"))
    x = marked.where("not probe").select("hash", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"), F.col("label").alias("label_a"))
    y = marked.select("hash", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"), F.col("label").alias("label_b"), "probe")
    close = F.expr(f"label_a <> label_b and (probe or n_a < n_b or a < b) and n_b - n_a between 0 and {edits} and {fits}")
    rest = x.join(y, "hash").where(close).select(*pair).distinct().join(stars, ["a", "b"], "left_anti")
    return links.union(verified(rest))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, shortest: int = SHORTEST, least: int | None = None) -> DataFrame:
    """doc_id, dropped: the numbers (from 0, ascending) of the lines that go, for documents that lose any."""
    rows = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null")
    lines = lines_of(rows, shortest, least)
    firsts = settle(lines.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("hits")))
    links = settle(line_links(rows, firsts, edits, shortest))
    labels = components(links)
    labelled = labels.join(firsts.select("id", "first"), "id")
    roots = labelled.groupBy("label").agg(F.min("first").alias("root"))
    roots = settle(labelled.join(roots, "label").select("id", "root"))
    stays = firsts.join(roots, "id", "left").select("id", F.coalesce("root", "first").alias("root"), "hits", F.col("root").isNotNull().alias("near"))
    stays = stays.where("hits > 1 or near").select("id", "root")
    places = may_hold(lines.select("doc_id", "line_no", "id"), "id", stays.select("id")).join(stays.hint("merge"), "id")
    gone = places.where("struct(doc_id, line_no) <> root")
    return settle(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")))


def without_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut from their texts, and columns _lines and _gone, their numbers before and of those cut."""
    names = docs.columns
    kept = F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains("dropped", i))
    keyed = dropped.select(F.col("doc_id").alias(id_col), "dropped")
    count = F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0))
    same = without(docs, id_col, keyed.select(id_col)).select(*names, count.alias("_lines"), F.lit(0).alias("_gone"))
    cut = may_hold(docs, id_col, keyed.select(id_col)).join(keyed.hint("merge"), id_col, "left")
    cut = cut.select(*[F.when(F.col("dropped").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c) for c in names], count.alias("_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("_gone"))
    return same.unionByName(cut)
