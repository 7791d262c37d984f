"""N-gram Jaccard join by parity sketches.

Every text becomes a set of shingle hashes. Two sets a, b with |a∩b| * den >= num * |a∪b| differ in at most
d = (|a|+|b|) * (den-num) / (den+num) elements, and their sizes differ by a factor num/den at most. Sizes fall in bands
whose limits grow by den/num, so a pair lies in one band or in neighbours; each set is sketched for its own band and the
next. For a band, the shingles are dealt into p parts by a hash, and each part keeps the XOR of its shingles' hashes. A
shingle that only one set has changes one part, so p > d parts leave at least one that is equal in both (pigeonhole). Sets
are joined on (band, part, XOR). A second sketch of parity bits (each shingle toggles one) has a Hamming distance that
is never above the true symmetric difference; it removes false candidates before the texts are compared exactly. As a
distance of random sketches ends at half the bits, a sketch has at least six bits for each element in which a pair of its
band may differ, and never under 1024. Its width is a power of two, so that a wide one folds to any narrower one by XOR.

Only connectedness is wanted, so no bucket is expanded into all its pairs. Each member meets its bucket's smallest member;
links found that way are contracted to components. In buckets that still hold several components, members of different
components meet inside tasks, and each member picks one other that its sketch allows. Picks are verified: a link contracts
two components, any other pair is not picked again. While all picks are links, each turn at least halves the components of
a bucket. After TURNS such turns the picks of a member double with each turn, so that few turns are left even where sketches
allow many pairs that are no links. Turns end when no pick is left: a pair that is linked is thus compared or already
connected, and nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from citeloom.llm.common import WORD_PATTERN, ascii_words, buckets, materialize, mix, shingles, sized_broadcast
from citeloom.llm.components import connected_components

#: The narrowest sketch; wide sets have more bits, see Bands.bits().
BITS = 1024
#: Members of a bucket that meet in one task.
BLOCK = 512
#: Longs of sketches that a block holds at most, where its members are wide.
BLOCK_LONGS = 1 << 20
#: Turns after the first in which each member picks one other; from then on the picks double with each turn.
TURNS = 4


class Bands:
    """Size bands for the threshold num/den, and the number of parts of each."""

    def __init__(self, num: int, den: int, top: int = 1 << 40):
        if not 0 < num <= den:
            raise ValueError("the threshold num/den must be above 0 and at most 1")
        self.num, self.den = num, den
        limits = [1]
        while limits[-1] < top:
            limits.append(limits[-1] * den // num + 1)
        self.limits = np.array(limits, np.int64)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.limits, size, "right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """The most elements in which a pair of the band may differ, and the parts: some more than that, see keys()."""
        most = 2 * (int(self.limits[band + 1]) - 1) * (self.den - self.num) // (self.den + self.num)
        return most, most + 1 + -(-most * 7 * (self.den - self.num) // (10 * (self.den + self.num)))

    def bits(self, size: int) -> int:
        """Parity bits of a set of size shingles: the power of two with six or more for each element its band lets differ."""
        return max(BITS, 1 << (6 * self.parts(self.of(max(1, size)))[0] - 1).bit_length()) if size else BITS

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Join keys of a set: one for each band it belongs to and each part.

        Empty parts carry no information but would all be equal. They may be left out if even then a pair keeps an equal
        part, i.e. if parts - most - empty >= 1; the surplus of parts makes this the usual case.
        """
        own, out = self.of(len(hashes)), []
        for band in (own, own + 1):
            most, parts = self.parts(band)
            if not most:
                continue  # only equal sets can link
            where = ((mix(hashes + np.uint64(band)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(where, kind="stable")
            full, first = np.unique(where[order], return_index=True)
            words = np.bitwise_xor.reduceat(hashes[order], first)
            if parts - most - (parts - len(full)) < 1:
                all_words = np.zeros(parts, np.uint64)
                all_words[full.astype(np.int64)] = words
                full, words = np.arange(parts, dtype=np.uint64), all_words
            out.append(mix(mix(full + np.uint64(band << 32)) ^ words))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sid(hashes: np.ndarray) -> int:
    """64 bits that name a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(column: pa.ChunkedArray | pa.Array, width: int) -> Iterator[np.ndarray]:
    for text in column:
        yield shingles(ascii_words(text.as_py()), width)


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch as longs: each hash toggles the bit that its lowest bits name."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Sketches:
    """Parity sketches of unlike widths, one after another in one array of longs."""

    def __init__(self, longs: np.ndarray, width: np.ndarray):
        self.longs, self.width, self.start = longs, width, np.cumsum(width) - width

    def folded(self, rows: np.ndarray, width: int, at: int, upto: int) -> np.ndarray:
        """Longs at to upto of the sketches of rows, folded to width longs."""
        out = np.zeros((len(rows), upto - at), np.uint64)
        for j in range(0, int(self.width[rows].max(initial=0)), width):
            has = self.width[rows] > j
            out[has] ^= self.longs[(self.start[rows[has]] + j + at)[:, None] + np.arange(upto - at)]
        return out


def signatures(documents: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(doc_id, hash, n, sid, bits) for each row: set size, 64-bit name of the set (null if empty), parity bits as longs.

    hash names the texts of rows without doc_id; it is null in other rows.
    """

    def run(batches):
        for batch in batches:
            n, sid, bits = [], [], [np.empty(0, np.int64)]
            for h in _sets(batch.column(2), width):
                n.append(len(h))
                sid.append(_sid(h) if len(h) else None)
                bits.append(parity(h, bands.bits(len(h))))
            longs = pa.array(np.concatenate(bits))
            offsets = pa.array(np.cumsum([len(b) for b in bits]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.ListArray.from_arrays(offsets, longs)], ["doc_id", "hash", "n", "sid", "bits"])

    rows = documents.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("hash"), "text")
    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, hash long, n long, sid long, bits array<long>")


def memberships(documents: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(key, sid, center): every set that shares a key with a smaller sid, and the smallest sid of that key.

    Rows of one Arrow batch that share a key are linked there, so that a key sends at most one row a batch to its window.
    """

    def run(batches):
        for batch in batches:
            seen, keys, sids = set(), [], []
            for h in _sets(batch.column(0), width):
                if len(h) and (s := _sid(h)) not in seen:
                    seen.add(s)
                    k = bands.keys(h)
                    keys.append(k)
                    sids.append(np.full(len(k), s, np.int64))
            if not keys:
                continue
            key, sid = np.concatenate(keys).view(np.int64), np.concatenate(sids)
            order = np.lexsort((sid, key))
            key, sid = key[order], sid[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            center = sid[first][np.cumsum(first) - 1]
            deal = np.where(first, key, mix(mix(key.view(np.uint64)) ^ sid.view(np.uint64)).view(np.int64))
            for at in range(0, len(key), 200_000):
                cut = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(deal[cut]), pa.array(sid[cut]), pa.array(key[cut], mask=first[cut]), pa.array(center[cut], mask=first[cut])], ["deal", "sid", "key", "center"])

    # Rows are dealt by their key, which then isn't sent twice, or by a hash of key and sid if they have a center already.
    rows = documents.select("text").mapInArrow(run, "deal long, sid long, key long, center long")
    smallest = F.first("sid").over(Window.partitionBy("deal").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(F.coalesce("key", "deal").alias("key"), "sid", F.coalesce("center", smallest).alias("center")).where("sid <> center")


def _near(pairs: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """Of pairs (u, v), those whose sizes and parity bits allow a link, with a document of each, or its hash if it has no doc_id."""
    side = lambda a: classes.select(*[F.col(c).alias(t) for c, t in (("sid", a), ("n", f"n_{a}"), ("bits", f"bits_{a}"), ("doc", f"doc_{a}"), ("hash", f"hash_{a}"))])
    least = F.least(F.size("bits_u"), F.size("bits_v"))

    def folded(bits):
        """bits as least longs: those whose places differ by a multiple of least are XORed."""
        ways = F.sequence(F.lit(0), (F.size(bits) / least).cast("int") - 1)
        one = lambda i: F.aggregate(ways, F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(F.col(bits), i + j * least)))
        return F.when(F.size(bits) == least, F.col(bits)).otherwise(F.transform(F.sequence(F.lit(0), least - 1), one))

    distance = F.aggregate(F.zip_with(folded("bits_u"), folded("bits_v"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = (F.least("n_u", "n_v") * bands.den >= F.greatest("n_u", "n_v") * bands.num)
    allowed = (F.col("n_u") + F.col("n_v")) * (bands.den - bands.num)
    return pairs.join(side("u"), "u").join(side("v"), "v").where(sizes & (distance * (bands.den + bands.num) <= allowed)).select("u", "v", "doc_u", "doc_v", "hash_u", "hash_v")


def _buckets(members: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, u): the members of the buckets named in keys, without buckets that hold the same members as another.

    Near copies share most of their parts, so most buckets repeat another; a set of members is known by its size and 128
    bits of their hashes.
    """
    rows = members.join(sized_broadcast(keys), "key", "left_semi")
    rows = materialize(rows.select("key", F.col("sid").alias("u")).unionByName(rows.select("key", F.col("center").alias("u"))).distinct(), "open-rows")
    alike = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("y"))
    one = materialize(alike.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "buckets")
    return materialize(rows.join(sized_broadcast(one), "key", "left_semi").select("key", "u"), "open-nodes")


def _picks(nodes: DataFrame, bands: Bands, doubled: int) -> DataFrame:
    """(key, u, v): each member u of a bucket with the smallest members v of other components whose size and parity bits allow a link.

    nodes: key, blocks, u, root_u, n, bits and no, the members that u is known not to link with. A task returns at most
    2 ** doubled rows for each member of a bucket, or of two blocks of it: a bucket is cut into so many blocks that each has
    about BLOCK members, and every two blocks meet in a task of their own. Where any pair is allowed, some pair is returned.
    """
    rows, own, many = nodes, F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"), 2**doubled
    ways = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("low"), F.greatest(b, own).alias("high")))
    rows = rows.select("key", F.explode(ways).alias("way"), own.alias("own"), "u", "root_u", "n", "bits", "no").select("key", "way.low", "way.high", "own", "u", "root_u", "n", "bits", "no")

    def near(p, q, root, n, sketches):
        """Of places p, q those pairs that sizes and sketches allow; sketches are read 16 longs at a time."""
        ok = (root[p] != root[q]) & (np.minimum(n[p], n[q]) * bands.den >= np.maximum(n[p], n[q]) * bands.num)
        p, q = p[ok], q[ok]
        width, limit = np.minimum(sketches.width[p], sketches.width[q]), (n[p] + n[q]) * (bands.den - bands.num)
        distance = np.zeros(len(p), np.int64)
        for w in np.unique(width).tolist():
            left = np.flatnonzero(width == w)
            for at in range(0, w, BITS // 64):
                if not len(left):
                    break
                low, high = min(p[left].min(), q[left].min()), max(p[left].max(), q[left].max())
                used = np.zeros(high - low + 1, bool)
                used[p[left] - low] = used[q[left] - low] = True
                part, place = sketches.folded(np.flatnonzero(used) + low, w, at, at + BITS // 64), np.cumsum(used) - 1
                distance[left] += np.bitwise_count(part[place[p[left] - low]] ^ part[place[q[left] - low]]).sum(1, dtype=np.int64)
                left = left[distance[left] * (bands.den + bands.num) <= limit[left]]
        ok = distance * (bands.den + bands.num) <= limit
        return p[ok], q[ok]

    def meet(low, high, own, u, root, n, sketches, first, no):
        a = np.flatnonzero(own == low)
        b = np.flatnonzero(own == high) if low != high else a
        picked, out = np.zeros(len(u), np.int64), [np.empty((2, 0), np.int64)]
        banned = [np.empty(0, np.int64)]
        for i, values in no:
            j = np.minimum(np.searchsorted(u, values), len(u) - 1)
            j = j[u[j] == values]
            banned += [i * len(u) + j, j * len(u) + i]
        banned = np.concatenate(banned)

        def pick(p, q):
            """The first pairs of each p, as many as it may still pick. Pairs come in order of q."""
            order = np.argsort(p, kind="stable")
            p, q = p[order], q[order]
            ok = np.arange(len(p)) - np.searchsorted(p, p) + picked[p] < many
            np.add.at(picked, p[ok], 1)
            out.append(np.stack([p[ok], q[ok]]))

        for at in range(0, len(a), 64):
            part = a[at : at + 64]
            to = b if low != high else a[at:]
            p, q = near(np.repeat(part, len(to)) + first, np.tile(to, len(part)) + first, root, n, sketches)
            p, q = p - first, q - first
            if len(banned):
                free = ~np.isin(p * len(u) + q, banned)
                p, q = p[free], q[free]
            pick(p, q)
            pick(q, p)
        p, q = np.concatenate(out, axis=1)
        return u[p], u[q]

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            key, low, high, own, u, root, n = (table.column(i).to_numpy() for i in range(7))
            bits = table.column(7).combine_chunks()
            sketches = Sketches(bits.flatten().to_numpy().view(np.uint64), bits.value_lengths().to_numpy().astype(np.int64))
            no = table.column(8).combine_chunks()
            upto, values = np.concatenate([[0], np.cumsum(no.value_lengths().to_numpy())]), no.flatten().to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            ends = np.array([0, *new.tolist(), table.num_rows])
            if batch is not None:
                ends = ends[:-1]
            # Buckets of two members, which are most, are compared many at once.
            size = np.diff(ends)
            two = ends[:-1][(size == 2) & ((upto[ends[1:]] == upto[ends[:-1]]) if len(size) else False)]
            found = []
            for at in range(0, max(1, len(two)), 20_000):
                p = two[at : at + 20_000]
                p, q = near(p, p + 1, root, n, sketches)
                found.append((key[p], u[p], u[q]))
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if j - i > 2 or (j - i == 2 and upto[j] > upto[i]):
                    cut = slice(i, j)
                    lists = [(k - i, values[upto[k] : upto[k + 1]]) for k in range(i, j) if upto[k + 1] > upto[k]] if upto[j] > upto[i] else []
                    p, q = meet(low[i], high[i], own[cut], u[cut], root, n, sketches, i, lists)
                    found.append((np.full(len(p), key[i]), p, q))
            columns = [np.concatenate([f[side] for f in found]) for side in range(3)]
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["key", "u", "v"])
            rest = None if batch is None else table.slice(int(ends[-1]))

    dealt = rows.repartition(buckets(nodes.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "u")
    return dealt.mapInArrow(run, "key long, u long, v long")


def _with_end(batches):
    yield from batches
    yield None


def _at(df: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """df with root_name, the component of its column name."""
    roots = found.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    return df.join(roots, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))


def _verified(near: DataFrame, documents: DataFrame, width: int, bands: Bands) -> DataFrame:
    """The pairs (u, v) of near that are links, by their whole texts. near is a written table."""
    wanted = materialize(near.select(F.col("doc_u").alias("doc_id")).unionByName(near.select(F.col("doc_v").alias("doc_id"))).distinct(), "wanted")
    found = documents.select("doc_id", "text").join(sized_broadcast(wanted), "doc_id", "left_semi").select("text")
    unnamed = near.where("doc_u is null").select(F.col("hash_u").alias("hash")).unionByName(near.where("doc_v is null").select(F.col("hash_v").alias("hash")))
    if not unnamed.isEmpty():
        unnamed = materialize(unnamed.distinct(), "unnamed")
        # Copies without doc_id are many rows of one hash: one text of each is enough.
        rows = documents.where("doc_id is null").select(F.xxhash64("text").alias("hash"), "text")
        found = found.unionByName(rows.join(sized_broadcast(unnamed), "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text")).select("text"))

    def named(batches):
        for batch in batches:
            sids, keep = OrderedDict(), []
            for i, h in enumerate(_sets(batch.column(0), width)):
                if len(h) and (s := _sid(h)) not in sids:
                    sids[s] = None
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(sids), pa.int64()), batch.column(0).take(pa.array(keep, pa.int64()))], ["sid", "text"])

    def compared(batches):
        cache: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(sid, text):
            if sid not in cache:
                cache[sid] = shingles(ascii_words(text), width)
                if len(cache) > 64:
                    cache.popitem(last=False)
            return cache[sid]

        for batch in batches:
            u, v, tu, tv = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                a, b = of(u[i].as_py(), tu[i].as_py()), of(v[i].as_py(), tv[i].as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * bands.den >= bands.num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = found.mapInArrow(named, "sid long, text string")
    both = near.select("u", "v").join(texts.select(F.col("sid").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("sid").alias("v"), F.col("text").alias("text_v")), "v")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(compared, "u long, v long").distinct()


def near_duplicates(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents (doc_id, text; other columns are ignored).

    Two rows link when their sets of width-word shingles have |a∩b| * den >= num * |a∪b|. component_id is the smallest
    doc_id that links reach. Null or wordless texts have the empty set and link with nothing: component_id is their own
    doc_id. Fewer than width words are one shingle. Repeated rows are equal sets, so they share a component. Rows without
    doc_id are linked like any others; where no row of a component has one, component_id is null. Sets are compared as 64-bit
    shingle hashes and named by 64 bits. Rows come in no order; an empty table gives no rows.
    """
    return _grouped(documents, width, num, den).select("doc_id", "n_shingles", "component_id")


def _grouped(documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """near_duplicates() with hash (as in signatures) and root, which names the component (null for the empty set)."""
    bands = Bands(num, den)
    documents = documents.select("doc_id", "text")
    signed = materialize(signatures(documents, width, bands), "signatures")
    classes = materialize(signed.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.min("hash").alias("hash"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    members = materialize(memberships(documents, width, bands), "members")
    met = materialize(members.select(F.col("sid").alias("u"), F.col("center").alias("v")).distinct(), "met")
    near = materialize(_near(met, classes, bands), "near")
    links = materialize(_verified(near, documents, width, bands), "links")
    found = connected_components(links)
    apart = materialize(_at(_at(met, "u", found), "v", found).where("root_u <> root_v").select("u", "v"), "apart")
    if not apart.isEmpty():
        # Buckets whose members are not yet connected: their members meet across components.
        keys = members.join(sized_broadcast(apart.select(F.col("u").alias("sid"), F.col("v").alias("center"))), ["sid", "center"], "left_semi").select("key").distinct()
        nodes = _buckets(members, materialize(keys, "open-keys"))
        unlike = near.select("u", "v").join(links, ["u", "v"], "left_anti")
        wide = classes.select(F.col("sid").alias("u"), F.size("bits").alias("longs"))
        nodes = materialize(nodes.join(wide, "u"), "sized-nodes")
        for turn in count():
            unlike = materialize(unlike, "unlike")
            placed = _at(nodes, "u", found)
            open_ = placed.groupBy("key").agg(F.min("root_u").alias("_l"), F.max("root_u").alias("_h"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("longs") / BLOCK_LONGS)).cast("int").alias("blocks"))
            placed = placed.join(sized_broadcast(materialize(open_.where("_l < _h").select("key", "blocks"), "open-buckets")), "key")
            placed = placed.join(classes.select(F.col("sid").alias("u"), "n", "bits"), "u")
            no = unlike.groupBy("u").agg(F.collect_list("v").alias("no"))
            placed = placed.join(no, "u", "left").withColumn("no", F.coalesce("no", F.array().cast("array<long>")))
            picks = materialize(_picks(materialize(placed.select("key", "blocks", "u", "root_u", "n", "bits", "no"), "open-members"), bands, max(0, turn - TURNS)), "picks")
            if picks.isEmpty():
                break
            # A bucket without a pick has none in a later turn either.
            nodes = nodes.join(sized_broadcast(materialize(picks.select("key").distinct(), "picking")), "key", "left_semi")
            picks = picks.select("u", "v").distinct()
            pairs = picks.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
            links = materialize(_verified(materialize(_near(pairs, classes, bands), "near"), documents, width, bands), "links")
            found = connected_components(links.unionByName(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
            same = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            unlike = unlike.unionByName(picks.join(same, ["u", "v"], "left_anti"))
    named = classes.select("sid", "doc").join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    component = named.select("sid", "root").join(lowest, "root").select("sid", "root", "component_id")
    return signed.select("doc_id", "hash", "n", "sid").join(component, "sid", "left").select("doc_id", "hash", "root", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents with one row of each component: that with the smallest doc_id; its columns are kept as they are.

    Of rows that repeat doc_id and text one stays. Wordless rows stay. Rows that share a doc_id but not a text stay together
    if any of them does, so that no text is lost. A component without any doc_id keeps one of its rows.
    """
    group = _grouped(documents, width, num, den)
    nameless = documents.where("doc_id is null")
    if not nameless.isEmpty():
        alone = group.where("root is not null and component_id is null").groupBy("root").agg(F.min("hash").alias("__hash"))
        alone = materialize(alone.select("__hash").distinct(), "nameless")
        names = documents.columns
        plain = [F.col(c) for c in names if "map<" not in documents.schema[c].dataType.simpleString()]
        rows = nameless.select(F.struct(*names).alias("row"), F.xxhash64("text").alias("__hash"), F.xxhash64(*plain).alias("order"), F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False)).alias("words"))
        one = rows.where("words").join(sized_broadcast(alone), "__hash", "left_semi").groupBy("__hash").agg(F.min_by("row", "order").alias("row"))
        nameless = rows.where("not words").select("row.*").unionByName(one.select("row.*"))
    any_copy = group.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    dropped = materialize(any_copy.where("not stays").select("doc_id"), "dropped")
    rows = documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"))
    repeated = materialize(rows.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").distinct(), "repeated")
    kept = documents.where("doc_id is not null").join(sized_broadcast(dropped), "doc_id", "left_anti").select(*documents.columns)
    if repeated.isEmpty():
        return kept.unionByName(nameless)
    again = kept.join(repeated, "doc_id", "left_semi").select(*documents.columns)
    w = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
    first = again.withColumn("__first", F.row_number().over(w)).where("__first = 1").select(*documents.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*documents.columns).unionByName(first).unionByName(nameless)
