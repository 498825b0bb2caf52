"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, and long lines after the first sentence
end past 96 code points (256 at most).  The distinct paragraphs' digests (60
bits of SHA-256) go into a sketch of three rows of cells; each row has one
cell for a digest, and a cell holds how many digests it took, their XOR and
the XOR of their check values.  Cells of two versions subtract; a cell left
with one digest gives it up, taking it out of the other rows, until the
difference is peeled off whole.  Where that fails the sketch is made anew and
larger: digests are dealt to segments by their first bits, about ``SEGMENT``
to a segment, each a sketch of its own; a segment that fails again is made
twice as large until it peels.  So the work grows with the length of the
texts, not with its square.

The fingerprint is the smallest sketch as text.  The likeness of two texts is
shared over all distinct paragraphs, from the sizes of both and of the
difference recovered.

:func:`edited` pairs each text with the next document's (falling doc_id, after
the last the first): ids are put in order by range, the ends of ranges meet in
a table of one row a range, and texts move twice, by their own key and, cut to
the part that is needed, by that of the document before.

Built-in functions only.  Cases.  Null text: empty; an empty text has an empty
sketch, and two empty texts are alike (1.0).  Null ids come last.  Rows that
repeat an id with another text: documents of their own, ordered by a hash.
Rows that repeat id and text: each but one is followed by its copy.  One row
alone is followed by itself.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import parts, same_type, stored

PARAGRAPH = r"(?:[^\n]{96,256}?[.!?]+|[^\n]{1,256})\n*|\n+"
WIDTH = 2  # bits that name a cell of a row, in the fingerprint
SEGMENT = 8  # digests a segment holds, about
MOST = 14  # bits that name a cell, where growing ends: no segment of that few digests gets there

_CELL = "struct<n:int,k:bigint,c:bigint>"
_FOUND = "array<struct<k:bigint,s:int>>"
_EMPTY = "named_struct('n', 0, 'k', 0L, 'c', 0L)"


def digests(text: str) -> str:
    """Distinct paragraph digests (longs below 2**60) of a text expression."""
    return (f"array_distinct(transform(regexp_extract_all({text}, r'{PARAGRAPH}', 0), "
            "p -> cast(conv(substring(sha2(cast(p as binary), 256), 1, 15), 16, 10) as bigint)))")


def check(k: str) -> str:
    """A check value that XOR of digests doesn't carry over to."""
    return f"(({k} % 1000000007L) * ({k} % 998244353L)) % 2147483647L"


def _units(digest_array: str, sign: int) -> str:
    return f"transform({digest_array}, u -> named_struct('k', u, 'c', {check('u')}, 's', {sign}))"


def _cells(units: str, bits: str) -> str:
    """A sketch of three rows of 2**bits cells over an array of (k, c, s)."""
    row = ("transform(sequence(0, cast(shiftleft(1, {bits}) as int) - 1), j -> aggregate({units}, {empty}, (a, u) -> "
           "if((shiftright(u.k, {bits} * {i}) & (shiftleft(1, {bits}) - 1)) = j, "
           "named_struct('n', a.n + u.s, 'k', a.k ^ u.k, 'c', a.c ^ u.c), a)))")
    return "concat(" + ", ".join(row.format(bits=bits, units=units, empty=_EMPTY, i=i) for i in range(3)) + ")"


def _peeled(cells: str, bits: str) -> str:
    """Digests (with signs) of a difference sketch, null if some stay entangled."""
    pure = ("array_distinct(transform(filter(st.cells, x -> abs(x.n) = 1 and x.c = " + check("x.k") + "), "
            "x -> named_struct('k', x.k, 's', x.n)))")
    place = f"shiftright(p.k, {bits} * cast(j div shiftleft(1, {bits}) as int)) & (shiftleft(1, {bits}) - 1)"
    taken = (f"transform(st.cells, (x, j) -> aggregate(pure, x, (a, p) -> if(({place}) = j % shiftleft(1, {bits}), "
             f"named_struct('n', a.n - p.s, 'k', a.k ^ p.k, 'c', a.c ^ {check('p.k')}), a)))")
    return f"""aggregate(sequence(1, 3 * cast(shiftleft(1, {bits}) as int)),
        named_struct('cells', {cells}, 'found', cast(array() as {_FOUND}), 'go', true),
        (st, r) -> if(not st.go, st, transform(array({pure}), pure -> if(size(pure) = 0,
            named_struct('cells', st.cells, 'found', st.found, 'go', false),
            named_struct('cells', {taken}, 'found', concat(st.found, pure), 'go', true)))[0]),
        st -> if(exists(st.cells, x -> x.n != 0 or x.k != 0 or x.c != 0), cast(null as {_FOUND}), st.found))"""


def sketch(digest_array: str) -> str:
    """Cells of the smallest sketch of an array of digests."""
    return f"transform(array({_units(digest_array, 1)}), us -> {_cells('us', str(WIDTH))})[0]"


def text_of(cells: str) -> str:
    """A sketch as text: count, digests and checks of each cell in hex."""
    return f"lower(array_join(transform({cells}, x -> concat(hex(x.n), '.', hex(x.k), '.', hex(x.c))), ' '))"


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def _larger(a: str, b: str) -> str:
    """Size of the difference by segments, each as large as it has to be."""
    segment = "shiftright(get(all.us, {at}).k, 60 - all.bits)"
    starts = f"filter(sequence(1, size(all.us)), i -> i = 1 or {segment.format(at='i - 2')} != {segment.format(at='i - 1')})"
    grown = (f"aggregate(sequence(3, {MOST}), cast(null as {_FOUND}), (done, w) -> if(done is not null, done, "
             f"{_peeled(_cells('g', 'w'), 'w')}))")
    return f"""transform(array(sort_array(concat({_units(a, 1)}, {_units(b, -1)}))), us ->
        transform(array(named_struct('us', us, 'bits', cast(greatest(0, ceil(log2(greatest(size(us), 1) / {float(SEGMENT)}))) as int))), all ->
        transform(array({starts}), starts ->
        aggregate(transform(starts, (i, q) -> slice(all.us, i, coalesce(get(starts, q + 1), size(all.us) + 1) - i)), 0,
            (total, g) -> total + size({grown})))[0])[0])[0]"""


def difference(cells_a: str, cells_b: str, a: str, b: str) -> str:
    """How many digests lie in one of two texts only: by the smallest sketch, else by larger ones."""
    small = _peeled("d", str(WIDTH))
    return f"""transform(array({minus(cells_a, cells_b)}), d -> transform(array({small}), found ->
        if(found is not null, size(found), {_larger(a, b)}))[0])[0]"""


def _likeness(a: str, b: str, apart: str) -> str:
    return f"if(size({a}) + size({b}) = 0, 1D, (size({a}) + size({b}) - {apart}) / cast(size({a}) + size({b}) + {apart} as double))"


# ------------------------------------------------------------------ the next document


def _chain(versions: DataFrame) -> DataFrame:
    """``key, doc_id, n, m`` with the key and length of the version before (the last one's for the first)."""
    order = [F.col("doc_id").isNull().alias("o0"), F.bitwise_not(F.col("doc_id")).alias("o1"), F.col("key").alias("o2")]
    by = ["o0", "o1", "o2"]
    dealt = stored(versions.select("*", *order).repartitionByRange(parts(versions.sparkSession), *by)
                   .withColumn("part", F.spark_partition_id()), "fp-order")
    ends = dealt.groupBy("part").agg(F.max(F.struct(*by, "key", "n")).alias("last"))  # one row for each range
    over = Window.orderBy("part")
    before = ends.select("part", F.coalesce(F.lag("last").over(over), F.max("last").over(
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    within = Window.partitionBy("part").orderBy(*by)
    return dealt.select("key", "doc_id", "n", "m", "part", F.lag(F.struct("key", "n")).over(within).alias("own")).join(
        F.broadcast(before), "part").select("key", "doc_id", "n", "m", F.coalesce(F.col("own.key"), F.col("before.key")).alias("before_key"),
                                            F.coalesce(F.col("own.n"), F.col("before.n")).alias("before_n"))


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, a, e, x`` of every row: digests of its text, of the edited text and of the next document's."""
    src = same_type(docs, {doc_id: "long", text: "string"}).select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = src.withColumn("key", F.expr(
        "substring(unhex(sha2(cast(concat(coalesce(cast(doc_id as string), 'null'), ':', text) as binary), 256)), 1, 16)"))
    versions = named.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text").cast("long")).alias("n"),
                                        F.count("*").alias("m"))
    chain = stored(_chain(versions), "fp-chain")
    known = named.groupBy("key").agg(F.first("text").alias("text")).join(chain, "key")
    own = known.selectExpr("key", "doc_id", "n", "substring(text, 1, cast(n - n div 2 as int)) AS kept", f"{digests('text')} AS a")
    # a text goes to the version before it; rows that repeat are followed by themselves
    goes = F.expr("""explode(filter(array(named_struct('key', before_key, 'n', before_n, 'copies', 1L),
        named_struct('key', key, 'n', n, 'copies', m - 1)), t -> t.copies > 0))""")
    follows = known.select(goes.alias("to"), "text").selectExpr(
        "to.key AS key", "to.copies AS copies", "substring(text, 1, cast(to.n div 2 as int)) AS head", f"{digests('text')} AS x")
    return own.join(follows, "key").selectExpr("doc_id", "n AS n_chars", "copies", "concat(kept, head) AS changed", "a", "x").selectExpr(
        "doc_id", "n_chars", "copies", "sha2(cast(changed as binary), 256) AS edited_sha256", "a", f"{digests('changed')} AS e", "x")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    rows = stored(edited(docs, doc_id, text), "fp-digests")
    cells = rows.withColumns({f"c{k}": F.expr(sketch(k)) for k in "aex"})
    sized = cells.withColumns({f"d{k}": F.expr(difference("ca", f"c{k}", "a", k)) for k in "ex"})
    return sized.select("*", F.expr("explode(array_repeat(0, cast(copies as int)))").alias("copy")).selectExpr(
        "doc_id", "n_chars", "edited_sha256", f"{text_of('ca')} AS fingerprint", f"{text_of('ce')} AS edited_fingerprint",
        f"{_likeness('a', 'e', 'de')} AS near_edited", f"{_likeness('a', 'x', 'dx')} AS near_next")
