"""Static range asymmetric numeral system over token ids, in numpy.

A segment has one frequency table, scaled to 2**SCALE, that all its blocks share. A block holds up to
``BLOCK`` ids, dealt to ``LANES`` interleaved coders with 64-bit states that give off 32-bit words; the
words of all lanes share one stream. Blocks are independent: the block table is a list of checkpoints
(first word, states of the lanes) with a CRC-32 of the ids, so any of them can be decoded alone, by
whichever task. Encoding and decoding step through all blocks and lanes of a segment at once.
"""

import zlib

import numpy as np

SCALE, LANES, BLOCK = 20, 64, 65_536
LOW = np.uint64(1 << 31)
U = np.uint64


def scaled(counts):
    """Counts to frequencies of sum 2**SCALE, each at least 1."""
    total, size = int(counts.sum()), 1 << SCALE
    freq = np.maximum(1, counts * size // max(total, 1)).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    rest = size - int(freq.sum())
    if rest >= 0:
        freq[order[0]] += rest
    else:
        for i in order:     # the commonest give back what the rare ones took
            take = min(int(freq[i]) - 1, -rest)
            freq[i] -= take
            rest += take
            if not rest:
                break
    return freq


def _rows(n):
    return -(-min(n, BLOCK) // LANES)


def encode(ids):
    """ids (uint32) -> dict with symbols, freq, and per block: states, word offsets, crc; and the words."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and ids.max() < 1 << 20:    # a vocabulary's ids: counted without sorting
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        rank = np.zeros(len(counts), np.int64)
        rank[symbols] = np.arange(len(symbols))
        at, counts = rank[ids], counts[symbols]
    else:
        symbols, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    if not len(ids):
        none = np.zeros(0, np.int64)
        return {"n": 0, "symbols": symbols, "freq": none, "states": np.zeros((0, LANES), U), "words": np.zeros(0, "<u4"), "offsets": np.zeros(1, np.int64), "crc": []}
    if len(symbols) > 1 << SCALE:
        raise ValueError("more different ids than the table can hold")
    freq = scaled(counts)
    low = np.cumsum(freq) - freq
    blocks, rows = -(-len(ids) // BLOCK), _rows(len(ids))
    # a short last block is filled up with the first symbol; the length tells where it ends
    grid = np.zeros(blocks * BLOCK if blocks > 1 else rows * LANES, np.int64)
    grid[:len(ids)] = at
    grid = grid.reshape(blocks, rows, LANES).transpose(1, 0, 2).reshape(rows, blocks * LANES)
    f, c = freq.astype(U), low.astype(U)
    x = np.full(blocks * LANES, LOW, U)
    words = np.zeros((rows, blocks * LANES), "<u4")
    given = np.zeros((rows, blocks * LANES), bool)
    room = U(1 << (63 - SCALE))
    for t in range(rows - 1, -1, -1):
        s = grid[t]
        fs = f[s]
        out = given[t] = x >= room * fs
        words[t] = (x & U(0xFFFFFFFF)).astype("<u4")
        x = np.where(out, x >> U(32), x)
        q = x // fs
        x = (q << U(SCALE)) + (x - q * fs) + c[s]
    streams, offsets = [], [0]
    for b in range(blocks):
        lane = slice(b * LANES, (b + 1) * LANES)
        streams.append(words[:, lane][given[:, lane]])
        offsets.append(offsets[-1] + len(streams[-1]))
    crc = [zlib.crc32(ids[i:i + BLOCK].tobytes()) for i in range(0, len(ids), BLOCK)]
    return {"n": len(ids), "symbols": symbols, "freq": freq, "states": x.reshape(blocks, LANES),
            "words": np.concatenate(streams), "offsets": np.array(offsets, np.int64), "crc": crc}


def decode(part, blocks=None):
    """The ids of a segment, or of the listed blocks only. A wrong checksum raises ValueError."""
    n = part["n"]
    if not n:
        return np.zeros(0, "<u4")
    total = len(part["states"])
    pick = np.arange(total) if blocks is None else np.asarray(blocks)
    rows = BLOCK // LANES if total > 1 else _rows(n)
    freq = part["freq"].astype(np.int64)
    slot = np.repeat(np.arange(len(freq)), freq)
    f, c = freq.astype(U), (np.cumsum(freq) - freq).astype(U)
    x = part["states"][pick].reshape(-1)
    words = np.concatenate((part["words"], np.zeros(LANES, "<u4"))).astype(U)
    at = part["offsets"][pick][:, None].copy()
    out = np.empty((rows, len(pick) * LANES), np.int64)
    mask = U((1 << SCALE) - 1)
    for t in range(rows):
        low = x & mask
        s = out[t] = slot[low]
        x = f[s] * (x >> U(SCALE)) + low - c[s]
        need = (x < LOW).reshape(len(pick), LANES)
        rank = np.cumsum(need, axis=1)
        word = words[np.minimum(at + rank - 1, len(words) - 1)]
        x = np.where(need, (x.reshape(need.shape) << U(32)) | word, x.reshape(need.shape)).reshape(-1)
        at += rank[:, -1:]
    ids = part["symbols"].astype("<u4")[out.reshape(rows, len(pick), LANES).transpose(1, 0, 2).reshape(len(pick), -1)]
    found = []
    for b, row in zip(pick.tolist(), ids):
        row = row[:min(n - b * BLOCK, BLOCK)]
        if zlib.crc32(row.tobytes()) != part["crc"][b]:
            raise ValueError(f"block {b}: the checksum differs")
        found.append(row)
    return np.concatenate(found)


def pack(part) -> bytes:
    """A segment as bytes: five lengths, then the parts little-endian; the table is deflated."""
    table = zlib.compress(np.concatenate((np.diff(part["symbols"].astype(np.int64), prepend=0), part["freq"])).astype("<u4").tobytes(), 6)
    head = np.array([part["n"], len(part["symbols"]), len(table), len(part["states"]), len(part["words"])], "<u4")
    return b"".join([head.tobytes(), table, part["offsets"].astype("<u4").tobytes(), np.array(part["crc"], "<u4").tobytes(),
                     part["states"].astype("<u8").tobytes(), part["words"].astype("<u4").tobytes()])


def unpack(data: bytes):
    n, kinds, table, blocks, words = np.frombuffer(data, "<u4", 5).tolist()
    at = 20
    pair = np.frombuffer(zlib.decompress(data[at:at + table]), "<u4").astype(np.int64)
    at += table

    def take(count, kind, width):
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += count * width
        return found

    offsets = take(blocks + 1, "<u4", 4).astype(np.int64)
    crc = take(blocks, "<u4", 4).tolist()
    states = take(blocks * LANES, "<u8", 8).reshape(blocks, LANES)
    return {"n": n, "symbols": np.cumsum(pair[:kinds]), "freq": pair[kinds:], "states": states,
            "words": take(words, "<u4", 4), "offsets": offsets, "crc": crc}
