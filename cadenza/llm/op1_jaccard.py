"""N-gram Jaccard join by T-occurrence search with short and long lists.

A document is the set of its ``k``-word shingles (64-bit hashes). Documents with
equal sets form one class, and the classes are joined. Two sets of Jaccard
similarity ``num/den`` or more share T = ceil(num n / den) shingles or more, n
the larger size. The inverted lists are ordered by length, estimated from counts
in a fixed number of buckets. As in DivideSkip a set keeps its most frequent
shingles aside as long lists, which are never built: of the rest, the short
lists, its partner must still be in c(n) or more. The short lists are merged by
a shuffle, occurrences are counted per candidate, and the long lists are probed
by binary search in the candidate's sorted set.

A list may be long all the same where many near copies meet, and its pairs are
never spelt out. Classes choose, among the
smallest members of their lists, the one they meet most often; following these
choices up gives families, each with a head. Every member is compared with its
head, and leaves the family if they have less than half in common. A
family's majority set holds what most of its members hold. Members that differ
from it in dx and dy differ from each other in (dx xor dy), so they link only if
they share o = ceil((|dx| + |dy| - D) / 2) of these few differences, D being the
largest difference that a linked pair of their sizes may have. If o <= 0 both
link to the family's centre, the member with the most room. Else they meet in a
short list of differences, where again only |d| - o + 1 are needed. Pairs of different
families come from the short lists directly, but a pair is made only if the sketches
of its sets allow a link: a sketch has a bit for each of ``SKETCH`` buckets, whether it
holds an odd number of shingles, so two sets differ in as many shingles or more as
their sketches in bits. Texts that share a frequent passage and little else fail that
before they become rows. Links between classes then give the connected components.

Edge cases: NULL, empty or wordless texts have the empty set and link with
nothing. Fewer than ``k`` words: the whole sequence is one shingle. Rows that
repeat a doc_id are one document for its links; its row carries the size of its
largest set. A NULL doc_id gets a row with a NULL component and no links. Ties
(equal sets) are one class. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import kernel
from cadenza.llm.common import documents, id_text, map_arrow, packed_among, unpack, written
from cadenza.llm.components import components

BUCKETS = 1 << 21               # of shingle counts: 8 MB on every executor
CHUNK = 16384                   # buckets in a row of the counts
C = 3                           # least number of short lists that a pair must share ...
C_SHARE = 40                    # ... or one for each so many shingles
SKETCH = 512                    # bits of a set's sketch; unrelated sets of up to about 1,100 shingles differ in more than a link allows
SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]


def _sets(col, k: int):
    """(row, sorted distinct shingles) of every text of an Arrow column."""
    for lo, hi, data, offs in kernel.blocks(col):
        data = kernel.lower(data)
        start, end, doc = kernel.words(data, offs)
        g, cut = kernel.grams(kernel.span_hash(data, start, end), kernel.bounds(doc, hi - lo), k)
        for d in range(hi - lo):
            s = np.sort(g[cut[d]:cut[d + 1]])
            yield lo + d, s[np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1]))]


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the set's members by bucket of their upper bits, packed into whole numbers."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profile(k: int):
    """(doc_id, class, set size) of every document, then the task's shingle
    counts by bucket, packed a chunk a row."""
    def run(batches):
        import zstandard

        total = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "cls", "n", "chunk", "counts"]
        for batch in batches:
            ids, rows, held = batch.column("doc_id").to_pylist(), [], []
            for row, s in _sets(batch.column("text"), k):
                rows.append((ids[row], _class_of(s), len(s)))
                held.append((s % np.uint64(BUCKETS)).astype(np.int64))
            if held:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()),
                                              pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names)
        chunks = np.flatnonzero(total.reshape(-1, CHUNK).any(1))
        c = zstandard.ZstdCompressor(level=1)
        packed = [c.compress(total[i * CHUNK:(i + 1) * CHUNK].tobytes()) for i in chunks]
        none = pa.nulls(len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(chunks.astype(np.int32)), pa.array(packed, pa.binary())], names)
    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    d, total = zstandard.ZstdDecompressor(), np.zeros(CHUNK, np.int64)
    for packed in pdf["counts"]:
        total += np.frombuffer(d.decompress(packed), np.int64)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "counts": [total.tobytes()]})


class Rule:
    """The similarity bound as whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.smallest = -(-num // (den - num)) if num < den else None   # sizes below link with equal sets only

        self.least = self.c(self.smallest) if self.smallest else 1

    def c(self, n: int) -> int:
        """How many short lists a pair must share that has a set of ``n``."""
        return max(1, min(max(C, n // C_SHARE), -(-self.num * n // self.den)))

    def c_column(self, n):
        return F.greatest(F.lit(1), F.least(F.greatest(F.lit(C), F.floor(n / C_SHARE)), F.ceil(self.num * n / self.den)))

    def short(self, n: int) -> int:
        """How many short lists a set of ``n`` shingles needs."""
        return min(n, n - -(-self.num * n // self.den) + self.c(n))

    def linked(self, common, na, nb):
        return self.den * common >= self.num * (na + nb - common)

    def spread(self, na, nb):
        """The largest symmetric difference of a linked pair."""
        return (self.den - self.num) * (na + nb) // (self.den + self.num)

    def within_spread(self, apart, na, nb):
        """Whether sets that are at least ``apart`` may link, on columns."""
        return (self.den + self.num) * apart <= (self.den - self.num) * (na + nb)


def _postings(k: int, rule: Rule, shared):
    """(shingle, class) of the short lists."""
    def run(batches):
        order = shared.value
        for batch in batches:
            grams, classes, seen = [], [], set()
            for _, s in _sets(batch.column("text"), k):
                if len(s) < rule.smallest:
                    continue
                c = _class_of(s)
                if c in seen:
                    continue
                seen.add(c)
                n = rule.short(len(s))
                rare = order[(s % np.uint64(BUCKETS)).astype(np.int64)]
                s = s[np.lexsort((s, rare))[:n]]
                grams.append(s)
                classes.append(np.full(len(s), c))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(np.concatenate(grams))), pa.array(np.concatenate(classes))],
                                                 ["gram", "cls"])
    return run


def _fetch(k: int):
    """(class, packed text, sketch) of the wanted documents."""
    def run(batches):
        for batch in batches:
            texts = pa.array([unpack(p) for p in batch.column("packed").to_pylist()], pa.string())
            cls, sketch = [], [np.zeros((0, len(SKETCHES)), np.int64)]
            for _, s in _sets(texts, k):
                cls.append(_class_of(s))
                sketch.append(_sketch(s)[None])
            sketch = np.concatenate(sketch)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), batch.column("packed"), *(pa.array(c) for c in sketch.T.copy())],
                                             ["cls", "packed", *SKETCHES])
    return run


def _unpacked_sets(batch, names: tuple[str, ...], k: int):
    """The sets of the batch's packed texts, each different class once."""
    known: dict[int, np.ndarray] = {}
    for cls, packed in names:
        new = {c: p for c, p in zip(batch.column(cls).to_pylist(), batch.column(packed).to_pylist(), strict=True) if c not in known}
        texts = pa.array([unpack(p) for p in new.values()], pa.string())
        known.update(zip(new, (s for _, s in _sets(texts, k)), strict=True))
    return known


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Probe the smaller set's members in the larger, sorted one."""
    if len(a) > len(b):
        a, b = b, a
    pos = np.searchsorted(b, a)
    return int((b[np.minimum(pos, len(b) - 1)] == a).sum()) if len(b) else 0


def _probe(k: int, rule: Rule):
    def run(batches):
        for batch in batches:
            sets = _unpacked_sets(batch, (("a", "ta"), ("b", "tb")), k)
            rows = [(x, y) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
                    if rule.linked(_overlap(sets[x], sets[y]), len(sets[x]), len(sets[y]))]
            a, b = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _compare(k: int):
    """Members that have at least half in common with their head, and the
    differences: added shingles before missing ones."""
    def run(batches):
        for batch in batches:
            sets = _unpacked_sets(batch, (("a", "ta"), ("b", "tb")), k)
            rows = []
            for x, h in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                p, q = sets[x], sets[h]
                common = _overlap(p, q)
                if 2 * common >= len(p) + len(q) - common:
                    rows.append((x, h, len(p), len(q), len(p) - common, np.concatenate((np.setdiff1d(p, q, True), np.setdiff1d(q, p, True))).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["cls", "head", "n", "head_n", "n_added", "diff"])
    return run


def _spell_out(batches):
    """(head, gram, of_head) of every difference."""
    for batch in batches:
        parts = []
        for h, added, diff in zip(*(batch.column(c).to_pylist() for c in ("head", "n_added", "diff")), strict=True):
            g = np.frombuffer(diff, np.uint64)
            parts.append((np.full(len(g), h), g, np.arange(len(g)) >= added))
        if parts:
            h, g, of_head = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(kernel.signed(g)), pa.array(of_head)], ["head", "gram", "of_head"])


_MEMBER = "cls long, head long, n long, phi long, n_added long, diff binary"


def _recentre(rule: Rule):
    """Differences from the family's majority set instead of from the head: those
    that most members have (``flips``) change sides. phi is |d| - r n, with
    r = (den - num) / (den + num), times (den + num)."""
    def run(batches):
        for batch in batches:
            rows = []
            for x, h, n, added, diff, flips in zip(*(batch.column(c).to_pylist() for c in ("cls", "head", "n", "n_added", "diff", "flips")), strict=True):
                g = np.frombuffer(diff, np.uint64)
                plus, minus = g[:added], g[added:]              # of x only; of the head only
                for of_head in (False, True):
                    f = np.array([v["gram"] for v in flips or () if v["of_head"] == of_head], np.int64).view(np.uint64)
                    if of_head:      # the majority lacks these: x differs where it has them
                        minus, plus = np.setdiff1d(minus, f), np.concatenate((plus, np.setdiff1d(f, minus)))
                    else:            # the majority has these: x differs where it lacks them
                        plus, minus = np.setdiff1d(plus, f), np.concatenate((minus, np.setdiff1d(f, plus)))
                d = np.concatenate((np.sort(plus), np.sort(minus)))
                rows.append((x, h, n, (rule.den + rule.num) * len(d) - (rule.den - rule.num) * n, len(plus), d.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.binary()], strict=True)],
                                             ["cls", "head", "n", "phi", "n_added", "diff"])
    return run


def _apart(p: bytes, q: bytes) -> int:
    p, q = np.sort(np.frombuffer(p, np.uint64)), np.sort(np.frombuffer(q, np.uint64))
    return len(p) + len(q) - 2 * _overlap(p, q)


def _centre(rule: Rule):
    """Adds whether a member is linked to its family's centre."""
    def run(batches):
        for batch in batches:
            linked = [rule.linked((n + zn - _apart(d, zd)) // 2, n, zn)
                      for n, zn, d, zd in zip(*(batch.column(c).to_pylist() for c in ("n", "zn", "diff", "zdiff")), strict=True)]
            keep = ["cls", "head", "n", "phi", "diff", "z", "zphi"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(linked, pa.bool_())], [*keep, "linked"])
    return run


def _difference_lists(rule: Rule):
    """(head, gram, class, linked, near): the short lists of differences that a
    member needs, shingles that the majority lacks before those it has. Members
    x and y link only if they share o = ceil((phi(x) + phi(y)) / 2) differences;
    the centre z has the smallest phi, so o <= 0 means that both link to z. A pair
    to find has a member that doesn't, whose phi is over -phi(z): against it o is
    (phi(x) - phi(z)) / 2 or more (``near``), against any (phi(x) + phi(z)) / 2."""
    unit = 2 * (rule.den + rule.num)

    def run(batches):
        for batch in batches:
            parts = []
            for x, h, phi, zphi, linked, diff in zip(*(batch.column(c).to_pylist() for c in
                                                       ("cls", "head", "phi", "zphi", "linked", "diff")), strict=True):
                g = np.frombuffer(diff, np.uint64)
                near = len(g) - max(1, -(-(phi - zphi) // unit)) + 1
                far = near if linked else len(g) - max(1, -(-(phi + zphi) // unit)) + 1
                g = g[:max(near, far, 0)]
                m = len(g)
                parts.append((np.full(m, h), g, np.full(m, x), np.full(m, linked), np.arange(m) < near))
            if parts:
                h, g, x, linked, near = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(kernel.signed(g)), pa.array(x), pa.array(linked), pa.array(near)],
                                                 ["head", "gram", "cls", "linked", "near"])
    return run


def _probe_differences(rule: Rule):
    def run(batches):
        for batch in batches:
            rows = [(x, y) for x, y, na, nb, p, q in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "da", "db")), strict=True)
                    if rule.linked((na + nb - _apart(p, q)) // 2, na, nb)]
            a, b = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _within_families(compared: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between members of one family that matter: all members
    linked to the centre, and every linked pair with a member that isn't."""
    num, den = rule.num, rule.den
    # the majority set: differences that more than half of a family (with its head) have
    size = compared.groupBy("head").agg((F.count("*") + 1).alias("size"))
    shared = map_arrow(compared, _spell_out, "head long, gram long, of_head boolean").groupBy("head", "gram", "of_head").agg(F.count("*").alias("n"))
    flips = shared.join(size, "head").where(2 * F.col("n") > F.col("size")).groupBy("head").agg(
        F.collect_list(F.struct("gram", "of_head")).alias("flips"))
    heads = compared.groupBy("head").agg(F.max("head_n").alias("n")).select(
        F.col("head").alias("cls"), "head", "n", F.lit(0).cast("long").alias("n_added"), F.lit(b"").alias("diff"))
    member = compared.select("cls", "head", "n", "n_added", "diff").unionByName(heads).join(flips, "head", "left")
    member = written(map_arrow(member.select("cls", "head", "n", "n_added", "diff", "flips"), _recentre(rule), _MEMBER), "family-members")
    z = member.groupBy("head").agg(F.min(F.struct("phi", "cls")).alias("z")).select("head", F.col("z.cls").alias("z"), F.col("z.phi").alias("zphi"))
    z = z.join(member.select(F.col("cls").alias("z"), "head", F.col("n").alias("zn"), F.col("diff").alias("zdiff")), ["head", "z"])
    member = map_arrow(member.join(z, "head").select("cls", "head", "n", "phi", "diff", "z", "zphi", "zn", "zdiff"), _centre(rule), "cls long, head long, n long, phi long, diff binary, z long, zphi long, linked boolean")
    member = written(member, "family-centres")
    to_centre = member.where("linked AND cls <> z").select(F.col("cls").alias("a"), F.col("z").alias("b"))
    lists = written(map_arrow(member, _difference_lists(rule), "head long, gram long, cls long, linked boolean, near boolean"), "differences")
    x, y = lists.alias("x"), lists.alias("y")
    same = [F.col("x.head") == F.col("y.head"), F.col("x.gram") == F.col("y.gram")]
    mixed = x.where("NOT x.linked").join(y.where("y.linked AND y.near"), same).select(F.col("x.head").alias("head"), F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    loose = x.where("NOT x.linked AND x.near").join(y.where("NOT y.linked AND y.near"), [*same, F.col("x.cls") < F.col("y.cls")])
    inside = mixed.unionByName(loose.select(F.col("x.head").alias("head"), F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))).distinct()
    # a class may be a member of one family and the head of another: its differences are the family's
    da = member.select("head", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("diff").alias("da"))
    db = member.select("head", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("diff").alias("db"))
    fits = F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")
    inside = inside.join(da, ["head", "a"]).join(db, ["head", "b"]).where(fits).select("a", "b", "na", "nb", "da", "db")
    inside = map_arrow(inside, _probe_differences(rule), "a long, b long")
    return to_centre.unionByName(inside)


def _families(lists: DataFrame) -> DataFrame:
    """(a, b): a class and its head; chains of "the smallest class that I meet
    most" followed up."""
    meet = lists.where("cls <> low").groupBy("cls", "low").agg(F.count("*").alias("n")).where(F.col("n") >= C)
    up = written(meet.groupBy("cls").agg(F.max(F.struct("n", (-F.col("low").cast("decimal(38,0)")).alias("neg"), "low")).alias("best"))
                 .select("cls", F.col("best.low").alias("head")), "family")
    for _ in range(3):      # pointer doubling: chains of up to 8 steps; longer ones just make more families
        n = up.select(F.col("cls").alias("head"), F.col("head").alias("next"))
        up = written(up.join(n, "head", "left").select("cls", F.coalesce("next", "head").alias("head")), "family")
    return up.select(F.col("cls").alias("a"), F.col("head").alias("b"))


def links(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n of every document; links (a, b) between classes)."""
    spark = docs.sparkSession
    text, rule = id_text(docs), Rule(num, den)
    profile = written(map_arrow(text, _profile(k), "doc_id long, cls long, n long, chunk int, counts binary"), "shingle-profile")
    members = profile.where("chunk IS NULL").select("doc_id", "cls", "n")
    if rule.smallest is None:                     # only equal sets link
        return members, members.limit(0).select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    chunks = profile.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(_add_up, "chunk int, counts binary")
    counts = np.zeros(BUCKETS, np.int64)
    for row in chunks.collect():                  # BUCKETS numbers in all
        counts[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.int64)
    shared = spark.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    # one exchange by shingle serves the lists' heads and the lists
    postings = map_arrow(text, _postings(k, rule, shared), "gram long, cls long").repartition("gram")
    met = postings.groupBy("gram").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("gram", "low")
    lists = written(postings.join(met, "gram").distinct(), "short-lists")
    shared.destroy()
    sizes = members.groupBy("cls").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    # texts of the classes that may have a partner, from one document each
    # (a partner of a set of n has num n / den shingles at least, and c doesn't fall with the size)
    smallest = F.ceil(num * F.col("n") / den)
    wanted = lists.groupBy("cls").agg(F.count("*").alias("lists")).join(sizes, "cls").where(F.col("lists") >= rule.c_column(smallest))
    wanted = written(wanted.select("cls", "n", "doc_id"), "classes")
    ids = wanted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    # a merge join: the tasks that unpack are others than those that pack
    texts = map_arrow(packed_among(docs, ids).join(ids.hint("merge"), "doc_id", "left_semi"), _fetch(k),
                      ", ".join(["cls long, packed binary", *(f"{c} long" for c in SKETCHES)]))
    texts = written(texts.dropDuplicates(["cls"]), "class-texts")
    ta = texts.select(F.col("cls").alias("a"), F.col("packed").alias("ta"))
    tb = texts.select(F.col("cls").alias("b"), F.col("packed").alias("tb"))
    member = _families(lists).where("a <> b").join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    member = written(map_arrow(member, _compare(k), "cls long, head long, n long, head_n long, n_added long, diff binary"), "family-compared")
    # pairs of different families, by number of short lists they share
    family = member.select("cls", "head")
    family = wanted.join(family, "cls", "left").select("cls", "n", F.coalesce("head", "cls").alias("head"))
    family = family.join(texts.select("cls", *SKETCHES), "cls")
    own = lists.join(family, "cls").select("gram", "cls", "n", "head", *SKETCHES).repartition("gram")
    several = own.groupBy("gram").agg(F.min("head").alias("lo"), F.max("head").alias("hi")).where("lo <> hi").select("gram")
    own = own.join(several, "gram", "left_semi")
    a = own.select("gram", F.col("cls").alias("a"), F.col("head").alias("ha"), F.col("n").alias("na"), *[F.col(c).alias(f"a{c}") for c in SKETCHES])
    b = own.select("gram", F.col("cls").alias("b"), F.col("head").alias("hb"), F.col("n").alias("nb"), *[F.col(c).alias(f"b{c}") for c in SKETCHES])
    fits = F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")
    apart = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in SKETCHES])
    near = rule.within_spread(apart, F.col("na"), F.col("nb"))
    pairs = a.join(b, [a["gram"] == b["gram"], F.col("a") < F.col("b"), F.col("ha") != F.col("hb"), fits, near])
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    enough = F.col("met") >= F.least(rule.c_column(F.col("na")), rule.c_column(F.col("nb")))
    pairs = written(pairs.where(enough).select("a", "b"), "candidates")
    across = map_arrow(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb"), _probe(k, rule), "a long, b long")
    return members, across.unionByName(_within_families(member, rule))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and class_size of every document."""
    members, found = links(docs, k, num, den)
    found = written(found, "class-links")
    roots = components(found)
    sizes = members.where("n > 0 AND doc_id IS NOT NULL").join(roots, F.col("cls") == F.col("node"), "left")
    sizes = written(sizes.select("doc_id", "n", "cls", F.coalesce("root", "cls").alias("root")), "class-members")
    # classes -> the smallest id of their component; an id with several rows joins their components
    low = sizes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    several = sizes.groupBy("doc_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("doc_id")
    if several.limit(1).count():
        shared = sizes.join(several, "doc_id", "left_semi").select("doc_id", "root").distinct()
        more = shared.groupBy("doc_id").agg(F.min("root").alias("b")).join(shared, "doc_id").select(F.col("root").alias("a"), "b")
        top = components(more)
        low = low.join(top, F.col("root") == F.col("node"), "left").select(low.root, F.coalesce(top.root, low.root).alias("top"), "component_id")
        low = low.join(low.groupBy("top").agg(F.min("component_id").alias("least")), "top").select("root", F.col("least").alias("component_id"))
    found = sizes.join(low, "root").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    rest = members.groupBy("doc_id").agg(F.max("n").alias("n"))
    out = rest.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id") == F.col("found_id"), "left")
    return out.select("doc_id", F.coalesce("n_shingles", "n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id."""
    gone = jaccard_components(docs, k, num, den).where("component_id < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 3, 90, 100)
