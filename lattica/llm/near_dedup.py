"""Near-duplicate classes by order MinHash and banded alignment.

A document's k-mers are its runs of WORDS words, labelled by their occurrence number. Each of
SKETCHES hash functions samples the PICK labelled k-mers of smallest hash and keeps them in text
order; the fingerprint of that sequence is a sketch. Documents that share a sketch are
candidates, and so are sensitive to edits and to moved text alike. Two documents are linked if
1 - edit distance / longer length >= SIMILARITY over words, by a bit-parallel alignment in a band
of that many edits. Classes are the connected components of links.

* Exact copies (equal word sequences) are one representative: its smallest doc_id.
* Sketches are taken in two rounds. In each bucket of equal sketches one member of each component
  so far is aligned with the bucket's centre (the smallest under one hash order for all buckets),
  not with each other: most of a group of g near copies is one component after the few sketches
  of the first round, which cost g alignments each at most; the second only sees what is apart.
* Members of a bucket that are still in different components after all rounds are then aligned
  with each other in cells of documents, behind lossless filters, so no candidate link is lost
  (`verify_apart`).
* Texts travel once as compressed blocks and are handed out to alignments; a centre's partners
  are dealt over tasks of at most SHARE.

A pair of five-word Jaccard similarity 0.8 is missed as a candidate with probability below
(1 - 0.8**PICK)**SKETCHES, about 1e-11, at 0.6 about 1e-3.

Texts without words (null, empty) and rows with a null doc_id are nobody's duplicates; a null
doc_id has a null class. Rows that repeat a doc_id with the same text are one document; with
other texts each is a document of its own, under a row key of id and text, and a class is named
by the smallest doc_id of its rows. Short texts of fewer than WORDS
words are one k-mer. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import textops as T
from .components import components, tasks_for

U64 = np.uint64
WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICK = 48, 4
#: Sketches that each round takes.
ROUNDS = (4, SKETCHES)
#: Documents at home in a cell and visitors in a task of the last step.
CELL, VISITORS = 1500, 500
#: Bits that say which words, with their occurrence number, a text has (an edit changes two at most).
BITS = 4096
#: Partners that one task aligns with a centre.
SHARE = 200
_ODD = np.random.default_rng(11).integers(0, 2**63, SKETCHES).astype(U64) * U64(2) + U64(1)


def labelled(x: np.ndarray) -> np.ndarray:
    """Fingerprints of entries with their occurrence number."""
    order = np.argsort(x, kind="stable")
    ranked, at = x[order], np.arange(len(x))
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    nth = np.empty(len(x), U64)
    nth[order] = at - np.maximum.accumulate(np.where(head, at, 0))
    return T.mix(x + nth * U64(0x9E3779B97F4A7C15))


def sketches(h: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of a document's word fingerprints, and the place of each one's first k-mer."""
    grams = T.window_hash(h, min(k, len(h)))
    label, at = labelled(grams), np.arange(len(grams))
    pick = min(PICK, len(grams))
    value = _ODD[:, None] * label[None, :]
    value ^= value >> U64(29)
    low = np.argpartition(value, pick - 1, axis=1)[:, :pick] if len(grams) > pick else np.tile(at, (SKETCHES, 1))
    low.sort(axis=1)
    out = np.arange(SKETCHES, dtype=U64)
    for j in range(pick):
        out = T.mix(out * U64(0xD6E8FEB86659FD93) + grams[low[:, j]])
    return out, low[:, 0].astype(np.int32)


def edit_distance(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`, by bit-parallel alignment."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    m, n = len(a), len(b)
    if most < min(m, n):
        return _banded(where, m, b, most)
    full = (1 << m) - 1
    vp, vn, dist, top = full, 0, m, 1 << (m - 1)
    for x in b:
        eq = where.get(x, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        dist += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | 1) & full
        vp, vn = ((hn << 1) | ~(d0 | hp)) & full, hp & d0
    return dist if dist <= most else None


def _banded(where: dict, m: int, b: list, k: int) -> int | None:
    """Only the 2k + 1 diagonals around the main one; bit j of a column is row i - k + j."""
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, dist = (((1 << (k + 1)) - 1) << (width - k - 1)), 0, k
    side = top >> 1
    turn = m - k
    room = 2 * k + abs(len(b) - m)
    for i, x in enumerate(b):
        eq = where.get(x, 0)
        eq = (eq >> (i - k) if i >= k else eq << (k - i)) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if i < turn:
            dist += not d0 & top
        else:
            dist += bool(hp & side) - bool(hn & side)
            side >>= 1
        if dist > room:
            return None
        shifted = d0 >> 1
        vp, vn = (hn | ~(shifted | hp)) & full, shifted & hp
    return dist if dist <= k else None


def similar(a: list, b: list, least: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    return edit_distance(list(a), list(b), int((1 - least) * longest + 1e-9)) is not None


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest of its words, n_words and sketches, for rows with an id and words."""

    def run(batches):
        for batch in batches:
            ids, digest, count, marks, place = [], [], [], [], []
            data, offsets = T.text_buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for lo, hi in T.slices(offsets):
                _, _, first, (h, h2) = T.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], T.SPACED, seeds=2)
                for i in range(hi - lo):
                    own = h[first[i] : first[i + 1]]
                    if not len(own):
                        continue
                    ids.append(names[lo + i])
                    whole = [int(T.window_hash(x[first[i] : first[i + 1]], len(own), s)[0]) for s, x in enumerate((h, h2))] if len(own) < 64 else _fold(own, h2[first[i] : first[i + 1]])
                    digest.append(np.array(whole, U64).tobytes() + len(own).to_bytes(8, "little"))
                    count.append(len(own))
                    s, p = sketches(own)
                    marks.append(s.view(np.int64).tolist()), place.append(p.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digest, pa.binary()), pa.array(count, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(place, pa.list_(pa.int32()))], names=["doc_id", "digest", "n_words", "marks", "places"])

    T.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, digest binary, n_words int, marks array<long>, places array<int>")


def _fold(a: np.ndarray, b: np.ndarray) -> list[int]:
    """128 bits of a long sequence of fingerprints."""
    out = []
    for s, x in enumerate((a, b)):
        powers = np.cumprod(np.full(len(x), T._BASE[s] | U64(1), U64))
        out.append(int(T.mix(np.array([np.add.reduce(T.mix(x) * powers)], U64))[0]))
    return out


def verify(pairs: DataFrame, packed: DataFrame, count: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) that align. Texts of both come from the packed blocks."""
    share = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"))
    wanted = dealt.select(F.col("b").alias("doc"), "a", "share").union(dealt.select(F.col("a").alias("doc"), "a", "share").distinct())
    wanted = wanted.select(F.pmod(F.xxhash64("doc"), F.lit(count)).cast("int").alias("block"), "doc", "a", "share")

    def hand_out(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and asked.num_rows:
            ids, known, data, offsets = B.unpack(rows)
            at = {int(d): i for i, d in reversed(list(enumerate(ids))) if known[i]}
            press, made = zstandard.ZstdCompressor(level=3), {}
            for doc, a, share in zip(*(asked[c].to_pylist() for c in ("doc", "a", "share"))):
                if doc not in made:
                    i = at[doc]
                    made[doc] = press.compress(data[offsets[i] : offsets[i + 1]].tobytes())
                for column, x in zip(out, (a, share, doc, made[doc])):
                    column.append(x)
        return B.batch(["a", "share", "doc", "body"], out, [pa.int64(), pa.int32(), pa.int64(), pa.binary()])

    given = packed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(hand_out, "a long, share int, doc long, body binary")

    def align(rows: pa.Table) -> pa.Table:
        a, docs = rows["a"][0].as_py(), rows["doc"].to_pylist()
        plain = zstandard.ZstdDecompressor()

        def words(body):
            data = np.frombuffer(plain.decompress(body), np.uint8)
            return T.words(data, np.array([0, len(data)]), T.SPACED)[3][0].tolist()

        bodies = rows["body"].to_pylist()
        centre = words(bodies[docs.index(a)])
        linked = [d for d, body in zip(docs, bodies) if d != a and similar(centre, words(body), least)]
        return B.batch(["a", "b"], [[a] * len(linked), linked], [pa.int64(), pa.int64()])

    return given.groupBy("a", "share").applyInArrow(align, "a long, b long")


def _near_labels(links: DataFrame) -> DataFrame:
    """node, component: not the whole component yet, but the smallest node within two links, which
    is enough to spare most alignments of a large group."""
    both = links.union(links.select("b", "a"))
    one = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    two = one.select(F.col("node").alias("m"), F.col("m").alias("further"))
    return one.join(two, "m", "left").select("node", F.least("m", F.coalesce("further", "m")).alias("component")).checkpoint()


def _placed(shared: DataFrame, found: DataFrame | None, turn: int) -> DataFrame:
    """mark, component, m: bucket members with their component so far and an order of centres."""
    if found is None:
        shared = shared.withColumn("component", F.col("rep"))
    else:
        shared = shared.join(found, shared["rep"] == found["node"], "left").withColumn("component", F.coalesce("component", "rep"))
    return shared.select("mark", "component", F.struct(F.xxhash64("rep", F.lit(turn)).alias("order"), "rep", "n", "place", "component").alias("m"))


def verify_apart(rest: DataFrame, apart: DataFrame, many: int, packed: DataFrame, count: int, least: float) -> DataFrame:
    """Links between members of one bucket in different components, all such pairs.

    Documents have a home cell of about CELL and visit the cells where a bucket of theirs has a
    member; a cell's visitors are dealt over tasks of about VISITORS. So what moves is a document
    for each cell, not one for each pair. In a cell, pairs that share a sketch go through lossless
    filters (length ratio, place of a shared sketch inside the band, bitmaps of labelled words
    that differ in no more bits than the edits allow) and are then aligned."""
    cells, salts = max(1, many // CELL), max(1, many // VISITORS)
    home = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(cells)).cast("int")
    marks = rest.select("mark", home.alias("cell")).distinct()
    visits = rest.select("mark", "rep").join(marks, "mark").select("rep", "cell").distinct().withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(salts)).cast("int"))
    open_cells = visits.select("cell", "salt").distinct()
    homes = apart.withColumn("cell", home).join(open_cells, "cell").withColumn("home", F.lit(True))
    guests = apart.join(visits, "rep").withColumn("home", F.lit(False))
    names = ["cell", "salt", "home", F.col("rep").alias("doc"), "component", "marks", "places"]
    wanted = homes.select(*names).union(guests.select(*names)).withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(count)).cast("int"))
    schema = "cell int, salt int, home boolean, doc long, component long, marks array<long>, places array<int>, body binary"

    def hand_out(rows: pa.Table, asked: pa.Table) -> pa.Table:
        body: list = []
        if rows.num_rows and asked.num_rows:
            ids, known, data, offsets = B.unpack(rows)
            at = {int(d): i for i, d in reversed(list(enumerate(ids))) if known[i]}
            press, made = zstandard.ZstdCompressor(level=3), {}
            for doc in asked["doc"].to_pylist():
                if doc not in made:
                    i = at[doc]
                    made[doc] = press.compress(data[offsets[i] : offsets[i + 1]].tobytes())
                body.append(made[doc])
        else:
            asked = asked.slice(0, 0)
        return asked.select(["cell", "salt", "home", "doc", "component", "marks", "places"]).append_column("body", pa.array(body, pa.binary()))

    given = packed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(hand_out, schema)

    def align(rows: pa.Table) -> pa.Table:
        plain, words, bits = zstandard.ZstdDecompressor(), [], []
        for body in rows["body"].to_pylist():
            data = np.frombuffer(plain.decompress(body), np.uint8)
            h = T.words(data, np.array([0, len(data)]), T.SPACED)[3][0]
            words.append(h.astype(np.uint64))
            seen, held = labelled(h), np.zeros(BITS // 64, U64)
            np.bitwise_or.at(held, (seen >> U64(6)).astype(np.int64) % len(held), U64(1) << (seen & U64(63)))
            bits.append(held)
        n, doc, component = np.array([len(w) for w in words]), rows["doc"].to_numpy(), rows["component"].to_numpy()
        marks, places = (rows[c].combine_chunks().flatten().to_numpy().reshape(len(n), SKETCHES) for c in ("marks", "places"))
        bits = np.array(bits).reshape(len(n), BITS // 64)
        host = np.asarray(rows["home"].to_numpy(), bool)
        homes = np.flatnonzero(host)
        links = [], []
        for g in np.flatnonzero(~host):
            x = homes[(doc[homes] < doc[g]) & (component[homes] != component[g])]
            edits = np.floor((1 - least) * np.maximum(n[x], n[g]) + 1e-9)
            x, edits = (v[np.abs(n[x] - n[g]) <= edits] for v in (x, edits))
            near = (marks[x] == marks[g]) & (np.abs(places[x] - places[g]) <= edits[:, None] + WORDS)
            x, edits = (v[near.any(1)] for v in (x, edits))
            x = x[np.bitwise_count(bits[x] ^ bits[g]).sum(1) <= 2 * edits]
            own = words[g].tolist()
            for i in x:
                if similar(words[i].tolist(), own, least):
                    links[0].append(doc[i]), links[1].append(doc[g])
        return B.batch(["a", "b"], links, [pa.int64(), pa.int64()])

    return given.groupBy("cell", "salt").applyInArrow(align, "a long, b long")


def clashing_ids(docs: DataFrame) -> DataFrame | None:
    """The ids that stand on rows with different texts, if there are any."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    found = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a != b").select(F.col("doc_id").alias("clash")).checkpoint()
    return None if found.isEmpty() else found


def _keyed(docs: DataFrame, clashing: DataFrame, key: str) -> DataFrame:
    """docs with a row key: the id, or of ids that stand on different texts a fingerprint of both."""
    own = F.xxhash64(docs["doc_id"].cast("long"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    return docs.join(clashing, docs["doc_id"] == clashing["clash"], "left").select(*(docs[c] for c in docs.columns), F.when(clashing["clash"].isNotNull(), own).otherwise(docs["doc_id"].cast("long")).alias(key))


def _named(docs: DataFrame, clashing: DataFrame, least: float) -> DataFrame:
    """key, doc_id, class_key, class_id, first (key and id of the row that stands for the class) of rows with an id."""
    keyed = _keyed(docs, clashing, "key")
    found = _classes(keyed.select(F.col("key").alias("doc_id"), "text"), least).select(F.col("doc_id").alias("key"), F.col("class_id").alias("class_key"))
    rows = found.where("key is not null").join(keyed.where("key is not null").select("key", "doc_id").distinct(), "key")
    first = rows.groupBy("class_key").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    return rows.join(first, "class_key").withColumn("class_id", F.col("first.doc_id"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) for each row of docs."""
    B.checkpoints(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clashing = clashing_ids(docs)
    if clashing is None:
        return _classes(docs, least)
    nameless = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return _named(docs, clashing, least).select("doc_id", "class_id").union(nameless)


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """As `classes`, of rows that repeat an id only with the same text."""
    spark = docs.sparkSession
    count = B.count_for(docs)
    marked = sketched(docs.where("doc_id is not null")).checkpoint()
    reps = marked.groupBy("digest").agg(F.min(F.struct("doc_id", "n_words", "marks", "places")).alias("r"))
    keys = reps.select(F.col("r.doc_id").alias("rep"), F.col("r.n_words").alias("n"), F.explode(F.arrays_zip(F.col("r.marks"), F.col("r.places"), F.sequence(F.lit(0), F.lit(SKETCHES - 1)))).alias("s"))
    keys = keys.select("rep", "n", F.col("s.marks").alias("mark"), F.col("s.places").alias("place"), F.col("s.2").alias("i"))
    buckets = keys.groupBy("mark").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("mark")
    shared = keys.join(buckets, "mark").checkpoint()
    packed = B.pack(docs, count)

    def may_match(p, q):
        edits = F.floor(F.lit(1 - least) * F.greatest(p["n"], q["n"]) + 1e-9)
        return (F.abs(p["n"] - q["n"]) <= edits) & (F.abs(p["place"] - q["place"]) <= edits + WORDS)

    links = tried = found = None
    for turn, high in enumerate(ROUNDS):
        placed = _placed(shared.where(F.col("i") < high), found, turn)
        # One member of each component in a bucket, then the bucket's centre.
        one = placed.groupBy("mark", "component").agg(F.min("m").alias("m"))
        centre = one.groupBy("mark").agg(F.min("m").alias("c"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        pairs = one.join(centre, "mark").where("m.component != c.component").where(may_match(F.col("m"), F.col("c"))).select(F.col("c.rep").alias("a"), F.col("m.rep").alias("b"))
        pairs = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"))
        if tried is not None:
            pairs = pairs.join(tried, ["low", "high"], "left_anti")
        pairs = pairs.checkpoint()
        many = pairs.count()
        if many:
            pairs = pairs.coalesce(tasks_for(many))
            tried = pairs.select("low", "high") if tried is None else tried.union(pairs.select("low", "high"))
            new = verify(pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), packed, count, least).checkpoint()
            links = new if links is None else links.union(new)
        if links is not None:
            found = components(links) if turn else _near_labels(links)
    rest = _placed(shared, found, 0)
    split = rest.groupBy("mark").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("mark")
    rest = rest.join(split, "mark").select("mark", "component", "m.rep").checkpoint()
    apart = rest.select("rep", "component").distinct().join(reps.select(F.col("r.doc_id").alias("rep"), F.col("r.marks").alias("marks"), F.col("r.places").alias("places")), "rep").checkpoint()
    many = apart.count()
    if many:
        new = verify_apart(rest, apart, many, packed, count, least).checkpoint()
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            found = components(links)
    if found is None:
        found = spark.createDataFrame([], "node long, component long")
    of_rep = reps.select("digest", F.col("r.doc_id").alias("rep")).join(found, F.col("rep") == found["node"], "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    known = marked.select("doc_id", "digest").join(of_rep, "digest").select("doc_id", "class_id")
    bare = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"))
    return known.union(bare)


def without_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that represent their class: its smallest doc_id. Of
    rows that repeat id and text one stays, the least by its other columns. Rows with a null id and
    texts without words stay (of the latter, repeated ones once); an empty table stays empty."""
    B.checkpoints(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clashing, key, nth = clashing_ids(texts), _free(docs, "key"), _free(docs, "nth")
    known = docs.where(docs["doc_id"].isNotNull())
    if clashing is None:
        known = known.withColumn(key, F.col("doc_id").cast("long"))
        gone = _classes(texts, least).where("class_id != doc_id").select(F.col("doc_id").alias(key)).distinct()
    else:
        known = _keyed(known, clashing, key)
        gone = _named(texts, clashing, least).where("key != first.key").select(F.col("key").alias(key)).distinct()
    # Maps have no order of their own.
    others = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text")]
    nth_row = F.row_number().over(Window.partitionBy("doc_id", F.md5(F.col("text").cast("binary"))).orderBy(*others or [F.lit(0)]))
    known = known.join(gone, key, "left_anti").withColumn(nth, nth_row).where(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    return known.union(docs.where(docs["doc_id"].isNull()))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(T.table(spark, sf_dir, "documents"))
