"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

A fingerprint has 64 bits; texts link at ``limit`` or fewer differing bits. Documents with one fingerprint
(where links are checked: with all fingerprints and the sketch equal) are folded first, so copies cost one row. The search cuts a fingerprint into a ring of ``limit`` + 1
segments. The pigeonring principle: if two fingerprints differ in at most ``limit`` bits, some segment
starts a chain in which every first l segments together differ in at most l * limit / (limit + 1) bits:
0 in the first, 1 in the first two, 2 in the first three, and so on. So each fingerprint is
filed under every pair of consecutive segments and looked up under the same pair with at most one bit of
the second segment turned. Where segments are short, one of the second's halves must be equal as well, and a
fingerprint is filed under the first segment with either half: few entries in place of one for each bit.
What meets is pruned by the longer chains and only then by the full distance.

Keys of two short segments are common, and what meets grows with the square of the documents. With ``chain`` 3 or
more a key is that many consecutive segments, all equal: less than the budgets allow, so one fingerprint alone finds
only some of the pairs, and several independent ones make up for it. Such a search proposes; it doesn't cover a distance.

Meetings are sorted by key and compared in blocks inside the tasks; what is known to be joined isn't
followed up again. A task emits no list of pairs but links that join what it has seen (a spanning forest
per chunk), so a large group of near copies yields about as many rows as it has members. A key that would
be large is dealt out in cells of its own.

A fingerprint counts votes, so texts that repeat one passage, and very short ones, come near to strangers; a passage
repeated often even fixes all 64 bits. Equal fingerprints meet like others, and their link is checked like others.
Where links stand for a similarity of the texts, ``agree`` checks each link at its meeting: a second
fingerprint of ``SKETCH`` bits, one for each of as many minimum hashes of the set of shingles, must agree in so many.
This only leaves out what is far below: with ``similarity`` the components of such links are rough groups, inside
which links are decided anew by the whole shingle sets of the texts, and only these make the final components.

The distance of two fingerprints scatters around what the similarity stands for: at 0.8 it is 9.7 bits of 64 with a
deviation of 2.9. ``prints`` fingerprints from independent hashes give each pair as many chances; all are filed in one
search, and any of them links.

Null and empty texts have fingerprint zero and link like any other. A null identifier never becomes a
component's name unless its whole component has none. Repeated rows fold; other columns aren't read.
"""

from pyspark.sql import DataFrame, functions as F

from homestream.llm.common import drop_written, kept_rows, utf8, written
from homestream.llm.components import components

SEED = 42
#: Expected rows of one key (from a sample of one in SAMPLE keys' rows) above which it is dealt out in cells.
CELL, SAMPLE = 65_536, 64
CHUNK = 400_000
#: Minimum hashes of a sketch. Texts of similarity s agree in (1 + s) / 2 of its bits: at 0.8 in 115 with a
#: deviation of 3.4, at 0.6 in 102, at 0.3 in 83. AGREE lies near four deviations below 115: it only spares work.
SKETCH, AGREE = 128, 102
#: Texts and shingles of one part of a rough group; larger groups are dealt out in parts. Expected pivots of those.
PART, PART_HASHES, PIVOTS = 4096, 4_000_000, 32
#: Segments of at most so many bits are halved in place of turning their bits.
HALVED = 10
#: Entries of one key up to which all such keys are worked off side by side.
FEW = 24
#: A key's upper bits tell its print and first segment.
PLACE = 57


def shingles(text: bytes, words: int):
    """Hashes of the shingles of ``words`` words of UTF-8 text, repeats included: A-Z lower-cased; the whole
    sequence if there are fewer words, nothing for none."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest
    w = text.lower().split()   # on bytes: ASCII letters and ASCII white space only
    n = len(w)
    joined = b" ".join(w)
    if n <= words:
        return np.array([digest(joined, SEED)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n - words + 1].tolist()
    stops = (ends[words - 1:] - 1).tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(hashes) -> int:
    """64-bit SimHash: a bit is set if more than half of the hashes have it."""
    import numpy as np
    m, votes = len(hashes), np.zeros(64, np.int64)
    for lo in range(0, m, 65_280):   # 256 rows of 255, so that a byte holds a row's count
        part = hashes[lo:lo + 65_280]
        bits = np.zeros((-(-len(part) // 255) * 255, 64), np.uint8)
        bits[:len(part)] = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > m, bitorder="little").view("<u8")[0])


def mixed(hashes, k: int):
    """The hashes as an independent hash function would give them, another for each k; for 0 as they are."""
    import numpy as np
    if not k:
        return hashes
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)   # the steps of SplitMix64
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def print_names(prints: int) -> list:
    return ["fp", *(f"f{k}" for k in range(1, prints))]


def sketch(hashes):
    """SKETCH bits in two 64-bit integers: bit 24 of each minimum over the hashes; zeros without any."""
    import numpy as np
    if not len(hashes):
        return np.zeros(2, np.uint64)
    factors = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):   # a piece of half a megabyte stays in the cache
        low = np.minimum(low, (factors[:, None] * hashes[at:at + 512]).min(1))
    return np.packbits((low >> np.uint64(24) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")


def set_mark(hashes):
    """Size and digest of sorted, distinct hashes."""
    from xxhash import xxh64_intdigest
    return len(hashes), xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def fingerprints(df: DataFrame, doc_id="doc_id", text="text", words=4, sketched=False, prints=1, hashed=False) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long. ``prints`` above one adds f1, f2, ... of other
    hashes, ``sketched`` the sketch as s0 and s1, and size and digest of the shingle set as n and d,
    ``hashed`` a hash of the text as h."""
    names = print_names(prints) + ["s0", "s1", "n", "d"] * sketched

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            found = []
            for t in utf8(b.column(1)):
                hashes = shingles(t, words)
                found.append((*(fingerprint(mixed(hashes, k)) for k in range(prints)), *((*sketch(hashes), *set_mark(np.unique(hashes))) if sketched else ())))
            made = np.array(found, np.uint64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], *[pa.array(np.ascontiguousarray(m).view(np.int64)) for m in made]],
                ["doc_id", *["h"] * hashed, *names])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if hashed:
        rows = rows.withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint" + "".join(f", {c} bigint" for c in ["h"] * hashed + names))


def ring(limit: int):
    """(shift, width) of each of the limit + 1 segments, three at least, low bits first."""
    m = max(3, limit + 1)
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), widths[i]) for i in range(m)]


def _masks(limit: int):
    """Per starting segment, the bit masks of its chains of length 1, 2, ... m."""
    segments = ring(limit)
    ones = [((1 << w) - 1) << s for s, w in segments]
    m = len(ones)
    return [[sum(ones[(i + j) % m] for j in range(k)) for k in range(1, m + 1)] for i in range(m)]


def _file(limit: int, values, first=0, chain=2):
    """Key and role of every entry of every fingerprint: (number of the fingerprint, key, probe) arrays.

    With ``chain`` above 2 a fingerprint has one own entry for each chain of so many segments.

    The key is (first + start, first segment, second segment). Own entries have role 0; entries with one bit
    of the second segment turned have role 1. A pair meets under an own entry of one of them: equal keys, or
    the other's turned key. A second segment of at most HALVED bits gives two own entries, one with each half.
    """
    import numpy as np
    segments = ring(limit)
    m, keys, roles, numbers = len(segments), [], [], []
    seg = [(values >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in segments]

    def add(key, role):
        keys.append(key)
        roles.append(np.full(len(values), role, np.int8))
        numbers.append(np.arange(len(values)))

    for i in range(m):
        j = (i + 1) % m
        w2 = segments[j][1]
        place = np.uint64(first + i) << np.uint64(PLACE)
        if chain > 2:
            key = np.zeros(len(values), np.uint64)
            for n in range(chain):
                key = key << np.uint64(segments[(i + n) % m][1]) | seg[(i + n) % m]
            add(place | key, 0)
            continue
        if w2 <= HALVED:
            half = w2 // 2
            for upper, part in enumerate((seg[j] & np.uint64((1 << half) - 1), seg[j] >> np.uint64(half))):
                add(place | np.uint64(upper << PLACE - 1) | (seg[i] << np.uint64(w2)) | part, 0)
            continue
        own = place | (seg[i] << np.uint64(w2)) | seg[j]
        for turned in [0, *(1 << b for b in range(w2))]:
            add(own ^ np.uint64(turned), int(turned > 0))
    return np.concatenate(numbers), np.concatenate(keys), np.concatenate(roles)


def _forest(a, b):
    """Links (a[i], b[i]) reduced to a spanning forest of their nodes."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a, b):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _joined(group, a, b):
    """The groups after links between positions a and b. A group's number is its smallest position."""
    import numpy as np
    while True:
        x, y = group[a], group[b]
        apart = x != y
        if not apart.any():
            return group
        root = np.arange(len(group))
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
        group = root[group]


def _meet_small(limit: int, node, fp, key, role, sketches, agree):
    """Links among entries sorted by key where few share a key: each with the next one of its key, the next but one, ...,
    all keys side by side."""
    import numpy as np
    masks = _masks(limit)
    m = len(masks)
    long = max(3, 2 * m // 3)
    by_size = np.array(masks, np.uint64).T       # [chain length - 1][first segment]
    first = (key >> np.uint64(PLACE)).astype(np.int64) % m
    out = []
    at, step = np.arange(len(key) - 1), 0
    while len(at):
        step += 1
        at = at[:np.searchsorted(at, len(key) - step)]
        at = at[key[at] == key[at + step]]
        diff, start = fp[at] ^ fp[at + step], first[at]
        near = np.bitwise_count(diff & by_size[long - 1][start]) <= long * limit // m
        near &= (role[at] == 0) | (role[at + step] == 0)
        i, diff, start = at[near], diff[near], start[near]
        ok = np.bitwise_count(diff) <= limit
        for size in range(2, m):
            ok &= np.bitwise_count(diff & by_size[size - 1][start]) <= size * limit // m
        i = i[ok]
        if sketches and len(i):
            apart = sum(np.bitwise_count(p[i] ^ p[i + step]).astype(int) for p in sketches)
            i = i[apart <= SKETCH - agree]
        out += zip(node[i].tolist(), node[i + step].tolist())
    return out


def _meet(limit: int, node, fp, key, role, sketches=(), agree=0):
    """Links among entries sorted by key. Blocks bound the size of a comparison."""
    import numpy as np
    masks = _masks(limit)
    m = len(masks)
    long = max(3, 2 * m // 3)   # a chain that leaves few pairs for the other checks
    cut = np.flatnonzero(np.diff(key.view(np.int64)) != 0) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
    owned = np.add.reduceat((role == 0).astype(np.int64), starts)
    some = (owned > 0) & (ends - starts > 1)
    few = np.repeat(some & (ends - starts <= FEW), ends - starts)
    links = _meet_small(limit, node[few], fp[few], key[few], role[few], [p[few] for p in sketches], agree)
    some &= ends - starts > FEW
    for s, e in zip(starts[some], ends[some]):
        y, own = fp[s:e], np.flatnonzero(role[s:e] == 0)
        wide = [part[s:e] for part in sketches]
        chains = masks[int(key[s] >> np.uint64(PLACE)) % m]
        group = np.arange(len(y))
        for lo in range(0, len(own), 256):
            x = own[lo:lo + 256]
            # where all entries are own ones, earlier rows have met every later one
            for at in range(lo // 2048 * 2048 if len(own) == len(y) else 0, len(y), 2048):
                diff = y[x, None] ^ y[None, at:at + 2048]
                near = np.bitwise_count(diff & np.uint64(chains[long - 1])) <= long * limit // m
                near &= group[x, None] != group[None, at:at + 2048]
                i, j = np.nonzero(near)
                diff = diff[i, j]
                ok = np.bitwise_count(diff) <= limit
                for size in range(2, m):
                    ok &= np.bitwise_count(diff & np.uint64(chains[size - 1])) <= size * limit // m
                i, j = x[i[ok]], at + j[ok]
                if wide and len(i):
                    apart = sum(np.bitwise_count(p[i] ^ p[j]).astype(int) for p in wide)
                    i, j = i[apart <= SKETCH - agree], j[apart <= SKETCH - agree]
                if len(i):
                    group = _joined(group, i, j)
        hung = np.flatnonzero(group != np.arange(len(y)))
        links += zip(node[s:e][hung].tolist(), node[s:e][group[hung]].tolist())
    return _forest(*zip(*links)) if links else []


def links(distinct: DataFrame, limit=4, partitions=None, agree=0, prints=1, chain=2) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what distances of at most ``limit`` do; with
    ``chain`` above 2, those of them with so many consecutive segments equal.

    With ``agree``, ``distinct`` holds sketches (s0, s1) too, and links whose sketches agree in fewer bits don't count.
    With ``prints`` above one it holds f1, f2, ... too, and a distance in any of them links. A column node, if there
    is one, names a row in the links, else its fp does.
    """
    if prints * len(ring(limit)) > 1 << 64 - PLACE or sum(sorted(w for _, w in ring(limit))[-chain:]) >= PLACE:
        raise ValueError("too many prints for the segments, or too long a chain")
    extra = ["s0", "s1"] if agree else []
    names = print_names(prints)
    distinct = distinct.select(F.col("node" if "node" in distinct.columns else "fp").alias("node"), *names, *extra)
    layout = "node bigint, fp bigint, key bigint, role tinyint" + "".join(f", {c} bigint" for c in extra)
    spark = distinct.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                for k in range(prints):
                    values = part.column(1 + k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    of, key, role = _file(limit, values, k * len(ring(limit)), chain)
                    at = pa.array(of)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), part.column(1 + k).take(at), pa.array(key.view(np.int64)), pa.array(role),
                         *[c.take(at) for c in part.columns[1 + prints:]]], ["node", "fp", "key", "role", *extra])

    def meet(batches):
        import numpy as np
        import pyarrow as pa
        held = None
        for b in batches:
            plain = [c.to_numpy() for c in b.columns]
            new = [c.view(np.uint64) if c.dtype == np.int64 else c for c in plain]   # role and cell are narrower
            held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            if len(held[0]) < CHUNK:
                continue
            inside = np.flatnonzero((held[2] != held[2][-1]) | (held[4] != held[4][-1]))
            if len(inside):
                end = inside[-1] + 1
                yield _links([h[:end] for h in held])
                held = [h[end:] for h in held]
        if held is not None and len(held[0]):
            yield _links(held)

    def _links(held):
        import numpy as np
        import pyarrow as pa
        node, fp, key, role, cell, *wide = held
        out = []
        for c in np.unique(cell):
            pick = cell == c
            out += _meet(limit, node[pick], fp[pick], key[pick], role[pick], [w[pick] for w in wide], agree)
        a, b = np.array(out, np.uint64).reshape(-1, 2).view(np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

    filed = distinct.mapInArrow(entries, layout)
    # Keys that many rows share get cells. The sample steers only where rows go.
    hot = (distinct.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
           .mapInArrow(entries, layout).groupBy("key").count()
           .filter(F.col("count") > CELL // SAMPLE)
           .select(F.col("key").alias("_hot"), F.ceil(F.col("count") * SAMPLE / CELL).cast("int").alias("_cells")))
    hot = written(hot, "hot-keys")
    if hot.isEmpty():
        dealt = filed.withColumn("cell", F.lit(0))
    else:
        # own entries fill rows of a square of cells, all entries its columns: each pair meets in one cell
        side = F.coalesce("_cells", F.lit(1))
        mine = F.pmod(F.xxhash64("node"), side).cast("int")
        spread = F.sequence(F.lit(0), side - 1)
        own_cells = F.when(F.col("role") == 0, F.transform(spread, lambda c: mine * side + c))
        all_cells = F.transform(spread, lambda c: c * side + mine)
        met = filed.join(hot, F.col("key") == F.col("_hot"), "left")
        dealt = met.select("node", "fp", "key", "role", *extra, F.explode(F.array_distinct(F.concat(
            F.coalesce(own_cells, F.expr("cast(array() as array<int>)")), all_cells))).alias("cell"))
    return (dealt.select("node", "fp", "key", "role", "cell", *extra).repartition(n, "key", "cell")
            .sortWithinPartitions("key", "cell").mapInArrow(meet, "a bigint, b bigint"))


def _similar(label, node, lead, sketches, sets, similarity, agree):
    """Links among the texts of a cell, each with a similarity of ``similarity`` at least by the sets themselves: they
    join what such pairs with a lead text in them join. Texts of one label are joined already."""
    import numpy as np
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(len(ids), bool)
    group = np.unique(label, return_inverse=True)[1]
    out = []
    for x in np.flatnonzero(lead):
        apart = sum(np.bitwise_count(p ^ p[x]).astype(int) for p in sketches)
        fits = np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1e-9
        near = np.flatnonzero((group != group[x]) & (apart <= SKETCH - agree) & fits & (sizes > 0))
        own = ids[starts[x]:starts[x] + sizes[x]]
        marked[own] = True
        for lo in range(0, len(near), 256):
            y = near[lo:lo + 256]
            y = y[group[y] != group[x]]
            if not len(y):
                continue
            first = np.cumsum(sizes[y]) - sizes[y]
            at = np.arange(sizes[y].sum()) + np.repeat(starts[y] - first, sizes[y])
            shared = np.add.reduceat(marked[ids[at]].astype(np.int64), first)
            y = y[shared >= similarity * (sizes[x] + sizes[y] - shared) - 1e-9]
            groups, some = np.unique(group[y], return_index=True)
            out += [(node[x], node[z]) for z in y[some]]
            group[np.isin(group, groups)] = group[x]
        marked[own] = False
    return out


def _cells(rows: DataFrame, similarity, agree) -> DataFrame:
    """(root, i, j, lead, label, node, s0, s1, shingles) -> confirmed links (a, b) inside each cell (root, i, j)."""
    def run(cell):
        import numpy as np
        import pyarrow as pa
        label, node, lead, s0, s1 = (cell.column(c).to_numpy() for c in ("label", "node", "lead", "s0", "s1"))
        sets = [np.frombuffer(x, "<u8") for x in cell.column("shingles").to_pylist()]
        out = _similar(label, node, lead, [s0.view(np.uint64), s1.view(np.uint64)], sets, similarity, agree)
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b)})

    return rows.groupBy("root", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _confirmed(df: DataFrame, text, words, classes: DataFrame, roots: DataFrame, similarity, agree) -> DataFrame:
    """Rough groups (node, root) -> links (a, b) that connect what pairs of a group with the similarity connect.

    A group of one part is compared whole. A larger one is first compared with some pivots, which joins most of a
    group of near copies in a pass that grows with its size. Then whatever isn't in the largest joined part is
    compared with the whole group, part by part.
    """
    def read(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            sets = [np.unique(shingles(t, words)) for t in utf8(b.column(b.num_columns - 1))]
            marks = np.array([set_mark(x) for x in sets], np.uint64).reshape(-1, 2)
            # a text that only shares the row's hash is another one
            at = np.flatnonzero(marks[:, 1] == b.column("d").to_numpy().view(np.uint64))
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:-1], pa.array([sets[i].astype("<u8").tobytes() for i in at], pa.binary())],
                [*kept.schema.names[:-1], "shingles"])

    members = classes.join(roots, F.col("node") == F.col("_node")).select("node", "root", "s0", "s1", "d", "n", "h")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).select(
        F.col("root").alias("_root"), "c",
        F.greatest(F.ceil(F.col("c") / PART), F.ceil(F.col("t") / PART_HASHES)).cast("int").alias("parts"))
    members = members.join(sizes, F.col("root") == F.col("_root")).drop("_root")
    texts = df.select(F.xxhash64(F.col(text).cast("string")).alias("_h"), F.col(text).cast("string").alias("text"))
    layout = "node bigint, root bigint, s0 bigint, s1 bigint, d bigint, c bigint, parts int"
    sets = written(
        members.join(texts, F.col("h") == F.col("_h")).select(*[f.split()[0] for f in layout.split(", ")], "text")
        .dropDuplicates(["node", "text"]).mapInArrow(read, layout + ", shingles binary"), "shingle-sets")
    part = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    out = ["root", "i", "j", "lead", "label", "node", "s0", "s1", "shingles"]

    pivot = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("c")) < PIVOTS
    lead = (F.col("parts") <= 1) | pivot
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    first = written(_cells(
        sets.withColumns({"label": F.col("node"), "lead": lead, "i": F.lit(0)})
        .withColumn("j", F.explode(F.when(F.col("lead"), everywhere).otherwise(F.array(part(F.col("parts"))))))
        .select(*out), similarity, agree), "confirmed-links")
    large = sets.filter("parts > 1")
    if large.isEmpty():
        return first
    joined = components(first).withColumnRenamed("root", "label").withColumnRenamed("node", "_n")
    narrow = large.select("node", "root", F.octet_length("shingles").alias("bytes")).join(
        joined, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("label", "node")).drop("_n").distinct()
    most = narrow.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    labelled = written(narrow.join(most, "root").withColumn("rest", F.col("label") != F.col("most")), "labels")
    rests = labelled.filter("rest").groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("bytes") / (8 * PART_HASHES))).cast("int").alias("_rests"))
    both = large.join(labelled.select(F.col("node").alias("_n"), "label", "rest"), F.col("node") == F.col("_n")).join(rests, "root")
    as_rest = both.filter("rest").withColumns({"lead": F.lit(True), "i": part(F.col("_rests"))}).withColumn("j", F.explode(everywhere))
    as_any = both.withColumns({"lead": F.lit(False), "j": part(F.col("parts"))}).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("_rests") - 1)))
    return first.unionByName(_cells(as_rest.select(*out).unionByName(as_any.select(*out)), similarity, agree))


def _labelled(df: DataFrame, doc_id, text, words, limit, agree, prints, similarity, hashed, chain=2) -> DataFrame:
    """One row per row of ``df``: doc_id, h if ``hashed``, fp, and of its component the smallest identifier (``none``:
    there is none) with, if ``hashed``, the smallest text hash under it (``first``)."""
    if similarity and not agree:
        raise ValueError("similarity needs agree")
    hashed = hashed or similarity > 0
    found = written(fingerprints(df, doc_id, text, words, agree > 0, prints, hashed), "fingerprints")
    # texts of one fingerprint are one class; where links are checked, those with all fingerprints, sketch and set equal
    same = [c for c in found.columns[1:] if c != "h"] if agree else ["fp"]
    more = [c for c in found.columns[1:] if c not in same]
    one = [F.min(F.struct(*more)).alias("one")] if more else []
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *["h"] * hashed)
    classes = found.groupBy(*same).agg(F.min(first).alias("first"), *one)
    node = F.monotonically_increasing_id() if agree else F.col("fp")
    # written, so that a number stays with its class
    classes = written(classes.select(node.alias("node"), *same, "first", *(f"one.{c}" for c in more)), "fingerprint-classes")
    roots = components(links(classes, limit, agree=agree, prints=prints, chain=chain)).withColumnRenamed("node", "_node")
    if similarity:
        sure = _confirmed(df, text, words, classes, roots, similarity, agree)
        roots = components(sure).withColumnRenamed("node", "_node")
    named = classes.join(roots, F.col("node") == F.col("_node"), "left").select(
        *same, F.coalesce("root", "node").alias("root"), "first")
    low = named.groupBy("root").agg(F.min("first").alias("first"))
    label = named.drop("first").join(low, "root").select(*same, "first")
    return found.join(label, same).select("doc_id", *["h"] * hashed, "fp", "first")


def near_duplicates(df: DataFrame, doc_id="doc_id", text="text", words=4, limit=4, agree=0, prints=1, similarity=0) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id (smallest reachable).

    With ``similarity``, which needs ``agree``, links are confirmed by the shingle sets of the texts.
    """
    return _labelled(df, doc_id, text, words, limit, agree, prints, similarity, False).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, doc_id="doc_id", text="text", words=5, limit=10, agree=AGREE, prints=9,
                         similarity=0.8, chain=3) -> DataFrame:
    """One document of each component stays, the one with the smallest identifier (null last); all columns.

    Five-word shingles. Pairs are proposed by one of ``prints`` fingerprints with ``chain`` consecutive segments equal and
    at most ``limit`` of 64 bits different, sketches leave out those far below, and the shingle sets decide: no pair
    below ``similarity`` links. Of pairs at 0.8 0.97 are proposed (by simulation), at 0.85 and more nearly all;
    of unrelated pairs 6.5 in 10,000 meet. A
    component may hold pairs below it that a chain of links joins.
    Decided by identifier and text (its hash), so another text under the identifier of a near copy stays, and of near
    copies under one identifier, or of a row repeated whole, one does.
    """
    found = _labelled(df, doc_id, text, words, limit, agree, prints, similarity, True, chain)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    decided = written(found.groupBy("doc_id", "h").agg(
        F.count(F.lit(1)).alias("n"), F.any_value(stays).alias("stays")), "near-decisions")
    whole = F.col(text).cast("string")
    return kept_rows(df, decided, {"doc_id": F.col(doc_id).cast("long"), "h": F.xxhash64(whole)}, whole)
