"""Prefix trie of conversations over minimal-perfect-hash node tables.

1. Turns are range-partitioned by conversation and order, so a long conversation spans partitions. A
   prefix is named by two polynomial hashes of its turns' digests; these can be continued from the end of
   the partition before, so one small state per partition is folded and handed on.
2. A partition is a shard. It holds the whole path of every conversation that begins there, hence
   every ancestor of its nodes. It lists its distinct prefix names with local counts.
3. The counts of a prefix are added up over shards. The shard of its smallest member owns it.
4. Per shard, a minimal perfect hash gives every prefix a slot, verified by the stored names. Counts are
   scattered into flat arrays by slot and added to the parents' slots, deepest level first.
5. Sums of a prefix that several shards hold are added up. What a conversation gathers in later
   partitions reaches its nodes in earlier ones as one number per border.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import cut, with_row_key
from surveyloom.llm.textarrays import mix

#: Turns to a shard, and the number of ids to a piece of the list of a node's ends.
SHARD, PIECE = 250_000, 1024
HEAD = 8
_STEPS = (0xD1342543DE82EF95, 0xAEF17502108EF2D9)
_INVERSE = tuple(pow(s, -1, 1 << 64) for s in _STEPS)
_FULL = (1 << 64) - 1
_SPLIT = np.uint64(0x9E3779B97F4A7C15)
_NODE = ("shard int, hi long, lo long, phi long, plo long, depth long, nbytes long, n long, low long, childful boolean, "
         "stub boolean, out boolean, ends binary")
_NODE_NAMES = [x.split()[0] for x in _NODE.split(", ")]
_SUMS = ("shard int, hi long, lo long, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, out boolean, through boolean")
_SUMS_NAMES = [x.split()[0] for x in _SUMS.split(", ")]


def head_length(conv: int) -> int:
    """Turns a conversation takes over from its base, by the checksum of its decimal id."""
    return zlib.crc32(str(conv).encode()) % (HEAD + 1)


def base_of(conv: int) -> int:
    """The id less its remainder by 5, which has the sign of the id, as in SQL."""
    return conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)


class NodeTable:
    """Minimal perfect hash of distinct two-word names: ``slots`` numbers them 0 to n - 1, and -1 for any other name.

    Names that alone fall on a place of a level's bit array get that place; the others go to the next
    level. A slot is the number of set bits before its place. Stored names verify every answer.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels, rest, base = [], np.arange(len(hi)), 0
        self.hi, self.lo = np.zeros_like(hi), np.zeros_like(lo)
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("Names of nodes are not distinct")
            place = self._places(hi[rest], lo[rest], len(self.levels), 2 * len(rest))
            taken = np.bincount(place, minlength=2 * len(rest)) == 1
            before = base + np.r_[0, np.cumsum(taken)]
            alone = taken[place]
            slots = before[place[alone]]
            self.hi[slots], self.lo[slots] = hi[rest[alone]], lo[rest[alone]]
            self.levels.append((taken, before))
            base, rest = base + int(taken.sum()), rest[~alone]

    @staticmethod
    def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * int(_SPLIT) & _FULL)
        return (mix(hi + mix(lo + seed)) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found, rest = np.full(len(hi), -1), np.arange(len(hi))
        for level, (taken, before) in enumerate(self.levels):
            place = self._places(hi[rest], lo[rest], level, len(taken))
            hit = taken[place]
            found[rest[hit]] = before[place[hit]]
            rest = rest[~hit]
        known = np.flatnonzero(found >= 0)
        wrong = (self.hi[found[known]] != hi[known]) | (self.lo[found[known]] != lo[known])
        found[known[wrong]] = -1
        return found


@dataclass
class Border:
    """What is known of the last conversation, and of the head of its base, at the end of a partition."""

    conv: int
    count: int
    lanes: tuple[int, int]
    own: list = field(default_factory=list)
    head: list = field(default_factory=list)


def _powers(step: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, step, np.uint64)])


class _Turns:
    """The turns of a partition in order, as arrays, with the rows where conversations begin."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        tables = [b for b in batches if b.num_rows]
        self.n = sum(b.num_rows for b in tables)
        if not self.n:
            return
        rows = pa.Table.from_batches(tables).combine_chunks()
        self.conv = rows.column("conv").to_numpy()
        self.nbytes = rows.column("nbytes").to_numpy()
        words = np.frombuffer(b"".join(rows.column("digest").to_pylist()), "<u8").reshape(-1, 2)
        self.turns = [mix(words[:, i].copy()) for i in (0, 1)]
        self.starts = np.flatnonzero(np.r_[True, self.conv[1:] != self.conv[:-1]])
        self.ends = np.r_[self.starts[1:], self.n]
        self.up = [_powers(s, self.n + 1) for s in _STEPS]
        self.total = [np.r_[np.uint64(0), np.cumsum(t * _powers(s, self.n)[1:])] for t, s in zip(self.turns, _INVERSE)]

    def prefix(self, lane: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial hash of the rows from ``first`` up to ``end``."""
        return self.up[lane][end] * (self.total[lane][end] - self.total[lane][first])

    def first_turns(self, segment: int) -> list:
        a, b = int(self.starts[segment]), int(min(self.ends[segment], self.starts[segment] + HEAD))
        return [(int(self.turns[0][i]), int(self.turns[1][i]), int(self.nbytes[i])) for i in range(a, b)]


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its last conversation, and the head of that one's base, as far as they lie in it."""
    turns = _Turns(batches)
    if not turns.n:
        return
    last = len(turns.starts) - 1
    conv, base = int(turns.conv[-1]), base_of(int(turns.conv[-1]))
    a = turns.starts[last:]
    lanes = [int(turns.prefix(i, a, np.array([turns.n]))[0]) for i in (0, 1)]
    heads = np.flatnonzero(turns.conv[turns.starts] == base)
    row = dict(part=TaskContext.get().partitionId(), first=int(turns.conv[0]), conv=conv, count=int(turns.n - a[0]), lanes=[str(x) for x in lanes],
               own=[str(x) for t in turns.first_turns(last) for x in t],
               head=[str(x) for s in heads.tolist() for t in turns.first_turns(s) for x in t])
    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("conv", pa.int64()), ("count", pa.int64()),
                                                             *[(x, pa.list_(pa.string())) for x in ("lanes", "own", "head")]]))


def _triples(flat: list[str]) -> list[tuple[int, int, int]]:
    return list(zip(*[map(int, flat[i::3]) for i in range(3)]))


def borders(rows: list) -> dict[int, tuple[Border | None, bool]]:
    """Per partition with turns: the state before it, and whether its last conversation goes on in a later one."""
    rows, out, before = sorted(rows, key=lambda r: r["part"]), {}, None
    for i, r in enumerate(rows):
        goes_on = i + 1 < len(rows) and rows[i + 1]["first"] == r["conv"]
        out[r["part"]] = (before, goes_on)
        now = Border(r["conv"], r["count"], tuple(map(int, r["lanes"])), _triples(r["own"]), _triples(r["head"]))
        if before is not None and base_of(before.conv) == base_of(now.conv):
            now.head = (before.head + now.head)[:HEAD]
        if before is not None and before.conv == now.conv:
            now.own = (before.own + now.own)[:HEAD]
            now.lanes = tuple((a * pow(s, now.count, 1 << 64) + b) & _FULL for a, b, s in zip(before.lanes, now.lanes, _STEPS))
            now.count += before.count
        before = now
    return out


def _names(lanes: list[np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    deep = depth.astype(np.uint64) * _SPLIT
    return mix(lanes[0] + deep), mix(lanes[1] ^ mix(deep))


def _heads(turns: _Turns, before: Border | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First turns per conversation of the shard, then those of the base before it, then none: count, bytes, prefix hashes."""
    k = len(turns.starts)
    many = np.r_[np.minimum(turns.ends - turns.starts, HEAD), 0, 0]
    cells = [np.zeros((k + 2, HEAD), np.uint64) for _ in range(2)]
    nbytes = np.zeros((k + 2, HEAD), np.int64)
    for i in range(HEAD):
        here = np.flatnonzero(many > i)
        at = turns.starts[here] + i
        for lane in (0, 1):
            cells[lane][here, i] = turns.turns[lane][at]
        nbytes[here, i] = turns.nbytes[at]

    def fill(row: int, own: list) -> None:
        many[row] = len(own)
        for i, turn in enumerate(own):
            cells[0][row, i], cells[1][row, i], nbytes[row, i] = turn

    if before is not None:
        fill(k, before.head)
        if before.conv == turns.conv[0]:
            fill(0, (before.own + turns.first_turns(0))[:HEAD])
            if base_of(before.conv) == before.conv:
                fill(k, (before.head + turns.first_turns(0))[:HEAD])
    sums = []
    for lane in (0, 1):
        total = np.zeros((k + 2, HEAD + 1), np.uint64)
        for i in range(HEAD):
            total[:, i + 1] = total[:, i] * np.uint64(_STEPS[lane]) + cells[lane][:, i]
        sums.append(total)
    return many, nbytes, sums


def _build(states):
    """Arrow function over a shard's turns: its distinct prefixes with local counts, and the conversations that end at each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _Turns(batches)
        if not turns.n:
            return
        part = TaskContext.get().partitionId()
        before, goes_on = states.value[part]
        yield from _shard_rows(part, turns, before, goes_on)
    return run


def _shard_rows(part: int, turns: _Turns, before: Border | None, goes_on: bool) -> Iterator[pa.RecordBatch]:
    k = len(turns.starts)
    convs = turns.conv[turns.starts]
    carried = before is not None and before.conv == convs[0]
    many, head_bytes, head_sums = _heads(turns, before)
    bases = np.array([base_of(c) for c in convs.tolist()])
    own_base = np.searchsorted(bases, bases)  # the base comes first among its family
    row_of_base = np.where(convs[own_base] == bases, own_base, k + 1)
    if before is not None and before.head:
        row_of_base[bases == base_of(before.conv)] = k
    # a base takes its head over from itself, which changes nothing
    h = np.array([0 if c == b else head_length(c) for c, b in zip(convs.tolist(), bases.tolist())], np.int64)
    m = np.minimum(h, many[row_of_base])
    earlier = np.zeros(k, np.int64)
    earlier[0] = before.count if carried else 0
    # what turns the hash of the own turns into that of the rebuilt ones
    delta = [s[row_of_base, m] - s[np.arange(k), np.minimum(h, many[:k])] for s in head_sums]
    for lane in (0, 1):
        if carried and before.count > h[0]:
            delta[lane][0] *= np.uint64(pow(_STEPS[lane], before.count - int(h[0]), 1 << 64))
    # own turns beyond the head
    segment = np.repeat(np.arange(k), turns.ends - turns.starts)
    j = np.arange(turns.n) - turns.starts[segment] + 1
    after = earlier[segment] + j - h[segment]
    kept = np.flatnonzero(after > 0)
    seg, step = segment[kept], j[kept] - np.maximum(0, h - earlier)[segment[kept]]
    depth = m[seg] + after[kept]
    lanes, parents = [], []
    for lane in (0, 1):
        own = turns.prefix(lane, turns.starts[seg], kept + 1)
        last = turns.prefix(lane, turns.starts[seg], kept)
        if carried:
            mine = seg == 0
            own[mine] += np.uint64(before.lanes[lane]) * turns.up[lane][j[kept][mine]]
            last[mine] += np.uint64(before.lanes[lane]) * turns.up[lane][j[kept][mine] - 1]
        lanes.append(own + delta[lane][seg] * turns.up[lane][step])
        parents.append(last + delta[lane][seg] * turns.up[lane][step - 1])
    hi, lo = _names(lanes, depth)
    phi, plo = _names(parents, depth - 1)
    nodes = [dict(hi=hi, lo=lo, phi=phi, plo=plo, depth=depth, nbytes=turns.nbytes[kept], conv=turns.conv[kept])]
    # prefixes taken over from the base, and the root, of conversations that begin here
    begin = np.arange(1 if carried else 0, k)
    for d in range(HEAD + 1):
        here = begin[m[begin] >= d]
        level = np.full(len(here), d, np.int64)
        hi, lo = _names([s[row_of_base[here], d] for s in head_sums], level)
        phi, plo = _names([s[row_of_base[here], max(d - 1, 0)] for s in head_sums], np.maximum(level - 1, 0))
        nodes.append(dict(hi=hi, lo=lo, phi=phi, plo=plo, depth=level, nbytes=head_bytes[row_of_base[here], max(d - 1, 0)] * (d > 0), conv=convs[here]))
    path = {c: np.concatenate([x[c] for x in nodes]) for c in nodes[0]}
    # where each conversation stands at the end of the shard: its last own turn, or the end of its head
    stand = _names([s[row_of_base[:k], m] for s in head_sums], m)
    stand = [x.copy() for x in stand]
    final = turns.ends - 1
    place = np.searchsorted(kept, final)
    some = np.flatnonzero((place < len(kept)) & (kept[np.minimum(place, max(len(kept) - 1, 0))] == final)) if len(kept) else np.zeros(0, np.int64)
    for i, name in enumerate(("hi", "lo")):
        stand[i][some] = nodes[0][name][place[some]]
    entry = None
    if carried:
        gone = max(0, before.count - int(h[0]))
        entry_lanes = [np.array([np.uint64(before.lanes[i] + int(delta[i][0]) & _FULL) if before.count >= h[0] else head_sums[i][row_of_base[0], m[0]]]) for i in (0, 1)]
        entry_depth = np.array([int(m[0]) + gone])
        entry = (*_names(entry_lanes, entry_depth), entry_depth)
        if not (len(seg) and seg[0] == 0):
            stand[0][0], stand[1][0] = entry[0][0], entry[1][0]
    yield from _local_nodes(part, path, entry, (stand[0][-1], stand[1][-1]) if goes_on else None)
    over = slice(0, k - 1 if goes_on else k)
    yield from _end_pieces(part, stand[0][over], stand[1][over], convs[over])


def _local_nodes(part: int, path: dict, entry, out) -> Iterator[pa.RecordBatch]:
    hi, lo, conv = path["hi"], path["lo"], path["conv"]
    order = np.lexsort((conv, lo, hi))
    first = np.flatnonzero(np.r_[True, (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
    lead = order[first]  # the smallest member of each prefix
    rows = {c: path[c][lead] for c in ("hi", "lo", "phi", "plo", "depth", "nbytes")}
    rows["n"], rows["low"] = np.diff(np.r_[first, len(order)]), conv[lead]
    table = NodeTable(rows["hi"], rows["lo"])
    stub = np.zeros(len(lead), bool)
    if entry is not None and table.slots(entry[0], entry[1])[0] < 0:
        for c, x in zip(("hi", "lo", "depth"), entry):
            rows[c] = np.r_[rows[c], x]
        for c in ("phi", "plo"):
            rows[c] = np.r_[rows[c], np.zeros(1, np.uint64)]
        for c in ("nbytes", "n", "low"):
            rows[c] = np.r_[rows[c], 0]
        stub = np.r_[stub, True]
        table = NodeTable(rows["hi"], rows["lo"])
    slot = table.slots(rows["hi"], rows["lo"])
    has_parent = (rows["depth"] > 0) & ~stub
    childful = np.zeros(len(slot), bool)
    upper = table.slots(rows["phi"], rows["plo"])
    childful[upper[has_parent & (upper >= 0)]] = True
    exits = np.zeros(len(slot), bool)
    if out is not None:
        exits[table.slots(np.array([out[0]]), np.array([out[1]]))] = True
    signed = lambda x: pa.array(x.view(np.int64))
    none = pa.array(stub)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(slot), part, np.int32)), signed(rows["hi"]), signed(rows["lo"]), signed(rows["phi"]), signed(rows["plo"]),
        pa.array(rows["depth"].astype(np.int64)), pa.array(rows["nbytes"].astype(np.int64)), pa.array(rows["n"].astype(np.int64)),
        pa.array(rows["low"].astype(np.int64), mask=stub), pa.array(childful[slot]), none, pa.array(exits[slot]), pa.nulls(len(slot), pa.binary())], _NODE_NAMES)


def _end_pieces(part: int, hi: np.ndarray, lo: np.ndarray, convs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ids of the conversations that end at a prefix, ascending, in pieces of bounded size; ``low`` is the first id."""
    order = np.lexsort((convs, lo, hi))
    hi, lo, convs = hi[order], lo[order], convs[order]
    new = np.r_[True, (np.diff(hi) != 0) | (np.diff(lo) != 0)] if len(hi) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    inside = np.arange(len(hi)) - np.flatnonzero(new)[group] if len(hi) else np.zeros(0, np.int64)
    first = np.flatnonzero(inside % PIECE == 0)
    ends = np.r_[first, len(hi)].astype(np.int64) * 8
    body = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(convs.astype("<i8"))]).cast(pa.binary())
    empty = {n: pa.nulls(len(first), pa.int64()) for n in ("phi", "plo", "depth", "nbytes", "n")}
    flags = pa.nulls(len(first), pa.bool_())
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(first), part, np.int32)), pa.array(hi[first].view(np.int64)), pa.array(lo[first].view(np.int64)), empty["phi"], empty["plo"],
        empty["depth"], empty["nbytes"], empty["n"], pa.array(convs[first].astype(np.int64)), flags, flags, flags, body], _NODE_NAMES)


def _accumulate(rows: pa.Table) -> pa.Table:
    """Arrow function over a shard's prefixes with their counts over all shards: sums over the subtrees, as far as this shard owns them."""
    cells = {c: rows.column(c).to_numpy() for c in ("hi", "lo", "phi", "plo")}
    cells = {c: x.view(np.uint64) for c, x in cells.items()}
    flag = {c: rows.column(c).to_numpy().astype(bool) for c in ("stub", "out", "leaf", "owned")}
    table = NodeTable(cells["hi"], cells["lo"])
    slot, count = table.slots(cells["hi"], cells["lo"]), rows.num_rows

    def scatter(values: np.ndarray) -> np.ndarray:
        out = np.zeros(count, values.dtype)
        out[slot] = values
        return out

    depth = scatter(rows.column("depth").to_numpy())
    conv = scatter(rows.column("conv_id").to_numpy())
    n_convs = scatter(rows.column("n_convs").to_numpy())
    stub, leaf, owned = (scatter(flag[c]) for c in ("stub", "leaf", "owned"))
    parent = scatter(np.where((rows.column("depth").to_numpy() > 0) & ~flag["stub"], table.slots(cells["phi"], cells["plo"]), -1))
    saved = np.where(owned, (n_convs - 1) * scatter(rows.column("nbytes").to_numpy()), 0)
    leaves = (owned & leaf).astype(np.int64)
    children = np.bincount(parent[owned & (parent >= 0)], minlength=count)
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        np.add.at(saved, parent[level], saved[level])
        np.add.at(leaves, parent[level], leaves[level])
    exits, through = np.zeros(count, bool), False
    for at in slot[flag["out"]].tolist():
        while at >= 0:
            exits[at] = True
            through = through or bool(stub[at])
            at = int(parent[at])
    shard = pa.array(np.full(count, rows.column("shard")[0].as_py(), np.int32))
    names = [pa.array(table.hi.view(np.int64)), pa.array(table.lo.view(np.int64))]
    upper = pa.array(np.where(parent >= 0, conv[parent], 0), mask=parent < 0)
    # a stub is a node of an earlier shard: its children count there, its sums are handed over in a row of their own
    of_stub = np.flatnonzero(stub)
    out = pa.Table.from_arrays([
        shard, *names, pa.array(conv), upper, pa.array(depth), pa.array(n_convs), pa.array(children.astype(np.int64)),
        pa.array(np.where(stub, 0, leaves)), pa.array(np.where(stub, 0, saved)), pa.array(exits & ~stub), pa.array(np.zeros(count, bool))], _SUMS_NAMES)
    if not len(of_stub):
        return out
    handed = dict(shard=shard[0].as_py(), n_leaves=int(leaves[of_stub[0]]), saved_tokens=int(saved[of_stub[0]]), through=through)
    return pa.concat_tables([out, pa.Table.from_pylist([handed], schema=out.schema)])


def handed_over(rows: list, parts: list[int]) -> list[tuple[int, int, int]]:
    """``(shard, leaves, saved)`` to add to the marked nodes of a shard: what their conversation gathers in later shards."""
    mine, out, later = {r["shard"]: r for r in rows}, [], (0, 0)
    for part in sorted(parts, reverse=True):
        if later != (0, 0):
            out.append((part, *later))
        r = mine.get(part)
        if r is None:
            later = (0, 0)
        else:
            extra = later if r["through"] else (0, 0)
            later = (r["n_leaves"] + extra[0], r["saved_tokens"] + extra[1])
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over pieces in order of node and first id: one hash per node, its ids streamed through."""
    name, digest, started, pending = None, None, False, np.zeros(0, np.int64)

    def feed() -> None:
        nonlocal started
        if len(pending):
            digest.update(("," if started else "").encode() + ",".join(map(str, np.sort(pending).tolist())).encode())
            started = True

    for batch in batches:
        done = []
        for hi, lo, low, body in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            ids = np.frombuffer(body, "<i8")
            if (hi, lo) != name:
                if name is not None:
                    feed()
                    done.append((*name, digest.hexdigest()))
                name, digest, started, pending = (hi, lo), hashlib.sha256(), False, ids
            elif len(pending) and low > pending.max():
                feed()
                pending = ids
            else:
                # pieces overlap only where a family of ids is cut by a border between shards
                pending = np.concatenate([pending, ids])
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["hi", "lo", "ends_sha256"])
    if name is not None:
        feed()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*name, digest.hexdigest())], ["hi", "lo", "ends_sha256"])


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with counts and sums over its subtree.

    Turns are ordered by ``turn``, nulls first, turns with equal numbers by the digest of role and text; null role and text
    are empty. Conversation c becomes the first h turns of conversation c - c % 5 (none if absent) and its own turns
    after its first h, h being crc32 of the decimal id modulo 9. Columns: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256`` (of the ids that end at the prefix). Rows with a null conversation are left out, repeated rows are
    repeated turns, other columns are ignored, and an empty table gives no rows.

    The hash of a node's ends is sequential by nature: the ids of one node stream through one task, 1024 to a row, in constant memory.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    turns = with_row_key(conversations, "_place").where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.octet_length(said[1]).cast("long").alias("nbytes"),
        F.unhex(F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"))).alias("digest"), F.col("_place").alias("place"))
    parts = max(conversations.sparkSession.sparkContext.defaultParallelism, -(-conversations.count() // SHARD))
    base = F.col("conv") - F.col("conv") % 5
    order = [base.asc(), (F.col("conv") != base).asc(), F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("place").asc()]
    ordered = cut(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "nbytes", "digest"))
    found = ordered.mapInArrow(_summary, "part int, first long, conv long, count long, lanes array<string>, own array<string>, head array<string>").collect()
    states = conversations.sparkSession.sparkContext.broadcast(borders(found))  # one small state per partition
    local = cut(ordered.mapInArrow(_build(states), _NODE))
    return _over_shards(local, [r["part"] for r in found])


def _over_shards(local: DataFrame, parts: list[int]) -> DataFrame:
    spark = local.sparkSession
    everywhere = Window.partitionBy("hi", "lo")  # at most one row per shard
    facts = F.when(~F.col("stub"), F.struct("depth", "phi", "plo", "nbytes"))
    alike = F.min(facts).over(everywhere).eqNullSafe(F.max(facts).over(everywhere))
    checked = F.when(alike, F.sum("n").over(everywhere)).otherwise(F.raise_error(F.lit("Two prefixes share a name")).cast("long"))
    nodes = local.where("ends is null").select(
        "shard", "hi", "lo", "phi", "plo", "depth", "nbytes", "stub", "out", "low", checked.alias("n_convs"), F.min("low").over(everywhere).alias("conv_id"),
        (~F.max("childful").over(everywhere)).alias("leaf"))
    nodes = nodes.withColumn("owned", F.coalesce(F.col("low") == F.col("conv_id"), F.lit(False))).drop("low")
    sums = cut(nodes.groupBy("shard").applyInArrow(_accumulate, _SUMS))
    given = handed_over(sums.where("out is null").select("shard", "n_leaves", "saved_tokens", "through").collect(), parts)  # one row per border
    later = spark.createDataFrame(given, "shard int, more_leaves long, more_saved long")
    whole = sums.where("out is not null").join(F.broadcast(later), "shard", "left")
    more = lambda c: F.when(F.col("out"), F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    totals = whole.groupBy("hi", "lo").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"), F.min("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum(F.col("n_leaves") + more("more_leaves")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + more("more_saved")).alias("saved_tokens"))
    pieces = local.where("ends is not null").select("hi", "lo", "low", "ends")
    ends = pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "low").mapInArrow(_hashes, "hi long, lo long, ends_sha256 string")
    return totals.join(ends, ["hi", "lo"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
