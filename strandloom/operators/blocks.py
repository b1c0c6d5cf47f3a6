"""Walks on networks of any size: the links in blocks of nodes, each step by array arithmetic.

A network is stored once, as arrays in the shared folder: nodes are numbered, a slot is a
(node, layer) with the number ``node * layers + layer``, and a block holds the links into a
range of nodes, sorted by slot. A step is one Spark job with a task for each block, which
reads the scores of all blocks, moves them along its own links and writes the scores of its
range; no row is shuffled. A task needs the links of its block and one vector of all slots.

Where a task can hold a few vectors of all slots (:data:`WHOLE_SLOTS`), no step is a job: every
task takes some seed sets and runs their walks to the end over the stored blocks, which all
tasks of a machine read from the same pages.

Only slots that a walk can reach are stored and moved: links from slots without a score are
put aside. Leaving out a layer or a node changes the totals
and the slots of the same stored network.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from strandloom.runtime import _filesystem, materialize, shared_dir

#: Moves of a network that one task may hold (about 0.3 GB of Python memory).
MAX_LOCAL_MOVES = 3_000_000
#: Links that one task holds on average.
LINKS_PER_BLOCK = 3_000_000
#: Slots of a network up to which one task runs whole walks, scores it then holds, and links it copies.
WHOLE_SLOTS, WHOLE_SCORES, WHOLE_LINKS = 8_000_000, 16_000_000, 12_000_000
#: A distance and its hops as one number: the bits of the hops, and what stands for no path.
HOP_BITS, NO_PATH = 16, 2**62
#: Rows that a task gives at a time.
ROWS_PER_BATCH = 100_000
#: Names of nodes that a task looks up at a time, and links that it moves at a time (few enough for a cache).
NAMES_AT_ONCE, LINKS_AT_ONCE = 4_000_000, 32_768
#: Links of a table of those that lead to slots of one number of links.
LINKS_PER_SQUARE = 20_000
#: Slots of a tile, from which a table's links come (their scores stay in a cache), and what times the mean links a hub has.
TILE, HUB = 2**16, 4
#: How far below the last of the best scores others are told too, so that any rounding to seven digits finds its ties.
BEST_MARGIN = 1e-7
#: Bytes of the stored scores of the sets that advance together.
SCORE_BYTES = 1_000_000_000


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", root))


def put(root: str, name: str, values: np.ndarray) -> None:
    """Store an array; a file is there as a whole or not at all."""
    fs, path = _opened(root)
    made = f"{path}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(made) as out:
        np.save(out, values)
    fs.move(made, f"{path}/{name}.npy")


def get(root: str, name: str) -> np.ndarray:
    fs, path = _opened(root)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    with fs.open_input_file(f"{path}/{name}.npy") as held:
        return np.load(held)


def piece(root: str, name: str, low: int, high: int) -> np.ndarray:
    """Rows ``low`` to ``high`` of a stored array, without the others."""
    fs, path = _opened(root)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.array(np.load(f"{path}/{name}.npy", mmap_mode="r")[low:high])
    with fs.open_input_file(f"{path}/{name}.npy") as held:
        np.lib.format.read_magic(held)
        kind = np.lib.format.read_array_header_1_0(held)[2]
        held.seek(held.tell() + low * kind.itemsize)
        return np.frombuffer(held.read((high - low) * kind.itemsize), kind)


def names_of(root: str) -> pa.Array:
    """The names of all nodes by their number."""
    fs, path = _opened(root)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(f"{path}/names.arrow")).read_all()["node"].combine_chunks()
    with fs.open_input_file(f"{path}/names.arrow") as held:
        return pa.ipc.open_file(held).read_all()["node"].combine_chunks()


def _number(root: str) -> Callable:
    """Writes the sorted hashes of all nodes, and their names in this order: a node's place is its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        h = held["h"].to_numpy() if len(held) else np.zeros(0, np.int64)
        order = np.argsort(h)
        every = h[order]
        put(root, "nodes", every)
        fs, path = _opened(root)
        made = f"{path}/names-{uuid.uuid4().hex}"
        named = pa.table({"node": held["node"].take(pa.array(order)).combine_chunks()}) if len(held) else pa.table({"node": pa.array([], pa.string())})
        with fs.open_output_stream(made) as out, pa.ipc.new_file(out, named.schema) as file:
            file.write_table(named)
        fs.move(made, f"{path}/names.arrow")
        differ = len(every) == 0 or bool((every[1:] != every[:-1]).all())
        yield pa.RecordBatch.from_pydict({"n": [len(every)], "differ": [differ]})

    return run


def _read(root: str) -> Callable:
    """Arrow batches (layer, src, dst, weight) of links -> stored parts, in which nodes and layers have the
    numbers of the part, and the names of each part's nodes.

    A part is named by what wrote it and counts only if its task came to the end; its row has its layers
    and their links."""

    def stored(held: list) -> pa.RecordBatch:
        links, part = pa.Table.from_batches(held), uuid.uuid4().hex
        layer = links["layer"].combine_chunks().dictionary_encode("encode")
        layers, codes = layer.dictionary.to_pylist(), layer.indices.to_numpy()
        counts = np.bincount(codes, minlength=len(layers)).tolist()
        if None in layers:
            links, codes = links.filter(links["layer"].is_valid()), codes[codes != layers.index(None)]
        ends = pa.chunked_array([*links["src"].chunks, *links["dst"].chunks], links["src"].type).combine_chunks().dictionary_encode("encode")
        put(root, f"read-{part}-layer", codes)
        put(root, f"read-{part}-ends", ends.indices.to_numpy())
        put(root, f"read-{part}-w", links["weight"].to_numpy())
        fs, path = _opened(root)
        pq.write_table(pa.table({"node": ends.dictionary}), f"{path}/read-{part}.parquet", filesystem=fs)
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([layers], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["part", "layers", "counts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += 2 * batch.num_rows
            if size >= LINKS_PER_BLOCK:
                yield stored(held)
                held, size = [], 0
        if size:
            yield stored(held)

    return run


def _named_once(root: str, parts: list[str], kind: pa.DataType) -> Callable:
    """The distinct names of the nodes of all parts, of which few are held beside the names found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(root)
        every, held, size = pa.array([], kind), [], 0
        for c, part in enumerate(parts):
            held.append(pq.read_table(f"{path}/read-{part}.parquet", filesystem=fs)["node"].combine_chunks().cast(kind))
            size += len(held[-1])
            if size >= NAMES_AT_ONCE or c + 1 == len(parts):
                every, held, size = pc.unique(pa.chunked_array([every, *held])), [], 0
        for _ in batches:
            for low in range(0, len(every), ROWS_PER_BATCH):
                yield pa.RecordBatch.from_arrays([every[low : low + ROWS_PER_BATCH]], names=["node"])

    return run


def _placed(root: str, known: list, width: int, n_blocks: int, kind: str, read: Broadcast) -> Callable:
    """Both directions of the links of a part, by block, in a part of its own."""
    layers = max(1, len(known))

    def run(k: int) -> list[tuple]:
        name, own = read.value[k]
        fs, path = _opened(root)
        mine, every = pq.read_table(f"{path}/read-{name}.parquet", filesystem=fs)["node"].combine_chunks(), names_of(root)
        number = np.zeros(len(mine), np.int64)
        for low in range(0, len(every), NAMES_AT_ONCE):
            at = pc.index_in(every[low : low + NAMES_AT_ONCE].cast(mine.type), mine)
            number[at.drop_null().to_numpy()] = low + np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        place = np.array([known.index(x) if x is not None else -1 for x in own], np.int64)
        x, y = np.split(number[get(root, f"read-{name}-ends")], 2)
        layer, weight = place[get(root, f"read-{name}-layer")], get(root, f"read-{name}-w")
        once = x != y
        a, b = x * layers + layer, y * layers + layer
        a, b, w = np.concatenate([a, b[once]]), np.concatenate([b, a[once]]), np.concatenate([weight, weight[once]])
        block = b // (layers * width)
        order = np.argsort(block.astype(np.uint16) if n_blocks < 2**16 else block, kind="stable")  # of 16 bits in linear time
        part = uuid.uuid4().hex
        put(root, f"part-{part}-a", a[order].astype(kind))
        put(root, f"part-{part}-b", b[order].astype(kind))
        put(root, f"part-{part}-w", w[order])
        return [(part, np.cumsum(np.bincount(block, minlength=n_blocks)).tolist())]

    return run


def _sorted(root: str, layers: int, width: int, slots: int, kind: str, parts: list, merge: bool) -> Callable:
    """Writes the links of a block, sorted by the slot they lead to; with ``merge`` repeated ones are added up."""

    def run(k: int) -> list[tuple]:
        spans = [(name, ends[k - 1] if k else 0, ends[k]) for name, ends in parts.value]
        spans = [s for s in spans if s[1] < s[2]]
        if not spans:
            return []
        a, b, w = (np.concatenate([piece(root, f"part-{name}-{x}", low, high) for name, low, high in spans]) for x in "abw")
        to = b.astype(np.int64) - k * width * layers
        order = np.argsort(to * slots + a) if width * layers * slots < 2**63 else np.lexsort((a, to))
        to = to[order]
        a, w = a[order], w[order]
        every = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (a[1:] != a[:-1])])
        if merge and 2 * len(every) < len(a):  # where few are repeated, they stay as they are
            a, w, to = a[every], np.add.reduceat(w, every), to[every]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        put(root, f"a{k}", a.astype(kind))
        put(root, f"w{k}", w)
        put(root, f"first{k}", first)
        put(root, f"to{k}", to[first].astype(np.int32))
        put(root, f"degree{k}", np.bincount(to // layers, minlength=width))
        return [(k, len(a))]

    return run


def ordered(root: str, n: int, width: int, held: set) -> tuple[np.ndarray, int]:
    """(nodes, hubs): the order of nodes in tables, first the hubs, at most as many as a tile has slots."""
    degree = np.zeros(n, np.int64)
    for k in held:
        low = k * width
        degree[low : low + width] = get(root, f"degree{k}")[: n - low]
    hubs = np.flatnonzero(degree > HUB * degree.mean()) if n else np.zeros(0, np.int64)
    if len(hubs) > TILE:
        hubs = np.sort(hubs[np.argpartition(-degree[hubs], TILE)[:TILE]])
    rest = np.ones(n, bool)
    rest[hubs] = False
    return np.concatenate([hubs, np.flatnonzero(rest)]), len(hubs)


def tabled(root: str, k: int, n_layers: int, width: int, order: np.ndarray, hubs: int) -> list[np.ndarray]:
    """[tables, places, weights, slots]: links of a block, of which each table has those from a tile of slots to the slots
    that as many lead to.

    Slots have the numbers ``layer * nodes + place`` with the nodes in ``order``. Every link is stored in both directions, so
    a block gives the links from hubs into its nodes, and those from its other nodes, which lie side by side, to any. A
    table is (first slot of its tile, links to a slot, slots); weights that are all 1 are left out."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, w, first, to = (get(root, f"{x}{k}") for x in ("a", "w", "first", "to"))
    from_, layer = np.divmod(np.asarray(a, np.int64), n_layers)
    into = np.repeat(to // n_layers, np.diff(np.r_[first, len(a)])) + k * width
    from_, into, even = place[from_], place[into], bool((w == 1).all())
    found: list[list] = [[], [], [], []]
    for x, y, mine in ((from_, into, from_ < hubs), (into, from_, into >= hubs)):
        x, y, at = x[mine], y[mine], layer[mine]
        if not len(x):
            continue
        low = 0 if x[0] < hubs else int(x.min())
        tile, here = np.divmod(x - low, TILE)
        tile = tile * n_layers + at
        key = (tile * n + y) * TILE + here
        if even:
            key.sort()
        else:
            by = np.argsort(key)
            key, weight = key[by], np.asarray(w)[mine][by]
        slot, here = np.divmod(key, TILE)
        begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        many = np.diff(np.r_[begin, len(slot)])
        tile, y = np.divmod(slot[begin], n)
        rows = np.lexsort((y, many, tile))
        cuts = np.flatnonzero(np.r_[True, (np.diff(tile[rows]) != 0) | (np.diff(many[rows]) != 0), True]).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            d, (sub, at) = int(many[rows[lo]]), divmod(int(tile[rows[lo]]), n_layers)
            step = max(1, LINKS_AT_ONCE // d)
            for own in (rows[c : min(c + step, hi)] for c in range(lo, hi, step)):
                links = (begin[own] + np.arange(d)[:, None]).ravel()
                found[0].append((at * n + low + sub * TILE, d, len(own)))
                found[1].append(here[links].astype(np.uint16))
                if not even:
                    found[2].append(weight[links])
                found[3].append((at * n + y[own]).astype(np.int32))
    empty = np.zeros((0, 3), np.int64), np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int32)
    return [(np.array(x, np.int64) if c == 0 else np.concatenate(x)) if x else empty[c] for c, x in enumerate(found)]


def reached(root: str, held: list, size: int, n_layers: int, there: np.ndarray, many: np.ndarray, starts: np.ndarray, rounds: int, change: float, most: int) -> np.ndarray | None:
    """The slots that walks from ``starts`` reach, or None if more than ``most`` links lead to them.

    Links are stored in both directions, so those into a slot also lead on from it."""
    active, near, links = np.zeros(len(there), bool), np.zeros(len(there), bool), 0
    near[starts] = True
    for _ in range(rounds + 1):
        near &= there
        near &= ~active
        now = np.flatnonzero(near)
        if not len(now):
            break
        active[now] = True
        near[:] = False
        for k in held:
            mine = now[slice(*np.searchsorted(now, (k * size, (k + 1) * size)))] - k * size
            if not len(mine):
                continue
            a, first, to = (get(root, f"{x}{k}") for x in ("a", "first", "to"))
            at = np.searchsorted(to, mine)
            at = at[to[np.minimum(at, len(to) - 1)] == mine]
            begins, ends = first[at], np.append(first[1:], len(a))[at]
            own = ends - begins
            links += int(own.sum())
            if links > most:
                return None
            near[a[np.repeat(begins - np.cumsum(own) + own, own) + np.arange(own.sum())]] = True
        if change:
            grid = near.reshape(-1, n_layers)
            who = now // n_layers
            grid[who[many[who] > 1]] = True
    return active


class Whole:
    """All that one task needs to walk from the given start slots on a prepared network."""

    def __init__(self, root: str, tag: str, shape: tuple, held: set, starts: np.ndarray, rounds: int, scale: float, change: float, sets: int, most: int | None = None) -> None:
        self.root, self.scale = root, scale
        n, n_layers, self.width, n_blocks = shape
        self.size = self.width * n_layers
        self.held = sorted(held)
        load = lambda name: np.concatenate([get(root, f"{tag}-{name}{k}") for k in range(n_blocks)])
        there, many = load("there"), load("many")
        active = reached(root, self.held, self.size, n_layers, there, many, starts, rounds, change, WHOLE_LINKS if most is None else most)
        far = active is None
        if far:  # all slots are numbered as stored
            active = np.ones(len(there), bool)
        #: The slots that can be reached, by which all else is numbered.
        self.slots = np.flatnonzero(active)
        self.place = np.cumsum(active) - 1
        self.active = active
        self.n_layers, self.exist = n_layers, there
        total, self.there = load("total")[self.slots], there[self.slots][:, None]
        self.total = np.where(total == 0, np.where(self.there[:, 0], np.nan, 1.0), total)[:, None]
        who = self.slots // n_layers
        self.first_of_node = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
        self.node_of = np.cumsum(np.r_[False, who[1:] != who[:-1]]) if len(who) else who
        n_of = many[who]
        self.chance = np.where(n_of > 1, change / np.maximum(n_of - 1, 1), 0.0)[:, None] if change else None
        self.links, self.squares, self.tables, self.even = None, None, None, False
        if far:
            self._tables(n)
            return
        few = [self._few(k) for k in self.held]
        a, w, to = (np.concatenate([f[c] for f in few]) if few else np.zeros(0, np.int64) for c in (0, 1, 3))
        first = np.cumsum(np.r_[0, [len(f[0]) for f in few]])
        self.links = a, w, np.concatenate([f[2] + o for f, o in zip(few, first)]) if few else first[:0], to
        self.even = bool((w == 1).all())
        if sets >= 4:
            self._square()

    def _tables(self, n: int) -> None:
        """The links in tables, as stored or else made here; walks then have the tables' numbers of slots."""
        fs, path = _opened(self.root)
        if fs.get_file_info(f"{path}/order.npy").type != pafs.FileType.NotFound:
            order = np.array(get(self.root, "order"))
            self.tables = [[np.asarray(get(self.root, f"table{x}{k}")) for x in range(4)] for k in self.held]
        else:
            order, hubs = ordered(self.root, n, self.width, set(self.held))
            self.tables = [tabled(self.root, k, self.n_layers, self.width, order, hubs) for k in self.held]
        self.stored = (order * self.n_layers + np.arange(self.n_layers)[:, None]).ravel()
        self.total, self.there = self.total[self.stored], self.there[self.stored]
        self.chance = self.chance[self.stored] if self.chance is not None else None

    def _few(self, k: int) -> tuple:
        """(from, weight, first, to) of a block's links between slots that can be reached."""
        a, w, first, to = (get(self.root, f"{x}{k}") for x in ("a", "w", "first", "to"))
        to = to.astype(np.int64) + k * self.size
        if len(self.slots) == len(self.active):
            return a, w, first, to
        used = self.active[a] & np.repeat(self.active[to], np.diff(np.r_[first, len(a)]))
        before = np.r_[0, np.cumsum(used)]
        begins, ends = before[first], before[np.r_[first[1:], len(a)]]
        some = ends > begins
        return self.place[a[used]].astype(np.int32), w[used], begins[some], self.place[to[some]]

    def _square(self) -> None:
        """The links by the number that lead to a slot: of one number they make a table. Those of a layer
        lie together, so that the scores they read stay in a cache."""
        a, w, first, to = self.links
        degree = np.diff(np.r_[first, len(a)])
        layer = self.slots[to] % self.n_layers
        order = np.lexsort((degree, layer))
        ends = np.flatnonzero(np.r_[True, (np.diff(layer[order]) != 0) | (np.diff(degree[order]) != 0), True][: len(order) + 1]).tolist()
        self.squares = []
        for begin, end in zip(ends, ends[1:]):
            rows = order[begin:end]
            d = int(degree[rows[0]])
            step = max(1, LINKS_PER_SQUARE // d)
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                at = first[own][:, None] + np.arange(d)
                self.squares.append((to[own], a[at], w[at][:, None, :]))
        self.links = None

    def moved(self, now: np.ndarray) -> np.ndarray:
        """The scores (slots, sets) after a step without restart."""
        sent, out = now / self.total, np.zeros_like(now)
        if self.squares is not None:
            for to, a, w in self.squares:
                out[to] = np.matmul(w, np.take(sent, a, axis=0, mode="clip"))[:, 0]  # places are in range; "clip" is the quickest
        else:
            columns, sums, held = np.ascontiguousarray(sent.T), np.zeros(out.shape[::-1]), np.zeros(LINKS_AT_ONCE)
            for tables, places, weights, slots in self.tables or ():
                link = slot = 0
                for tile, d, rows in tables.tolist():
                    from_, weight = places[link : link + d * rows].astype(np.intp), weights[link : link + d * rows]
                    into = slots[slot : slot + rows]
                    link, slot = link + d * rows, slot + rows
                    held = held if d * rows <= len(held) else np.zeros(d * rows)
                    here = held[: d * rows]
                    for s in range(len(columns)):
                        np.take(columns[s, tile : tile + TILE], from_, out=here, mode="clip")  # places are in range; "clip" is the quickest
                        if len(weight):
                            here *= weight
                        sums[s, into] += here.reshape(d, rows).sum(axis=0)
            if self.links is not None:
                a, w, first, to = self.links
                cuts = np.unique(np.searchsorted(first, np.arange(0, len(a), LINKS_AT_ONCE))).tolist()
                for low, high in zip(cuts, [*cuts[1:], len(first)]):
                    begin, end = first[low], first[high] if high < len(first) else len(a)
                    held = held if end - begin <= len(held) else np.zeros(end - begin)
                    here, from_, weight, into, at = held[: end - begin], a[begin:end].astype(np.intp), None if self.even else w[begin:end], to[low:high], first[low:high] - begin
                    for s in range(len(columns)):
                        np.take(columns[s], from_, out=here, mode="clip")
                        if weight is not None:
                            here *= weight
                        sums[s, into] = np.add.reduceat(here, at)
            out = sums.T
        out *= self.scale
        if self.chance is not None and len(now):
            across = now * self.chance
            if self.tables is not None:
                grid = across.reshape(self.n_layers, -1, now.shape[1])
                out += (grid.sum(axis=0) - grid).reshape(out.shape)
            else:
                out += np.add.reduceat(across, self.first_of_node, axis=0)[self.node_of] - across
        out *= self.there
        return out

    def walk(self, p0: np.ndarray, restart: float, tolerance: float, rounds: int, failure: type) -> np.ndarray:
        """Converged scores (slots, sets) from the start scores of the same shape.

        Chebyshev's iteration takes the steps; its change is that of a plain step, and a plain
        step is the last. Where it falls behind the 1 - restart of plain steps, these go on.
        A walk goes on while it reaches more slots, as far as plain steps might."""
        c = 1 - restart
        if self.tables is not None:
            p0 = p0[self.stored]
        far = 2 + math.ceil(math.log(tolerance / 2) / math.log(c)) if c > 0 else 1
        now, before, omega, plain, most, reached = p0, None, 2.0, False, None, -1
        for r in range(2 * rounds):
            after = self.moved(now)
            after *= c
            after += restart * p0
            off = np.abs(after - now).sum(axis=0).max(initial=0.0)
            held, reached = reached, np.count_nonzero(after)
            if off < tolerance and (reached == held or r + 1 >= far):
                if self.tables is not None:
                    now[self.stored] = after
                return after if self.tables is None else now
            most = off if most is None else most
            if not plain and off > 10 * most * c**r + tolerance:
                plain = True
            if plain or before is None:
                now, before = after, now
                continue
            omega = 1 / (1 - c * c * omega / 4)
            now, before = before + omega * (after - before), now
        raise failure(f"a walk still changed by {off:g} after {2 * rounds} rounds")

    def reduced(self, scores: np.ndarray, how: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, values): the scores of one set over the layers of each node that has any.

        "mean" is over the layers that have a score and hold the node, all else over ``n`` layers."""
        if not len(scores):
            return np.zeros(0, np.int64), np.zeros(0)
        who, there = self.slots[self.first_of_node] // self.n_layers, scores != 0
        some = np.logical_or.reduceat(there, self.first_of_node)
        if how == "geometric":
            whole = (np.add.reduceat(there.astype(np.int64), self.first_of_node) >= n) & (np.minimum.reduceat(scores, self.first_of_node) > 0)
            value = np.where(whole, np.exp(np.add.reduceat(np.log(np.maximum(scores, 1e-300)), self.first_of_node) / n), 0.0)
        else:
            value = np.add.reduceat(scores, self.first_of_node)
            if how == "arithmetic":
                value /= n
            elif how == "mean":
                active = np.unique(self.slots[there] % self.n_layers)
                value = value[some] / self.exist.reshape(-1, self.n_layers)[who[some]][:, active].sum(axis=1)
                return who[some], value
            elif how != "sum":
                raise ValueError(f"unknown reduction: {how}")
        return who[some], value[some]

    def ranks(self, scores: np.ndarray, own: list[np.ndarray], targets: list[int], n: int, layers: int) -> list[float]:
        """The rank of each set's target among all ``n`` nodes but the set's ``own``; a target below 0 is one more."""
        who = self.slots[self.first_of_node] // self.n_layers
        score = np.round(np.add.reduceat(scores, self.first_of_node, axis=0) / layers, 12) + 0.0
        out = []
        for s, (mine, target) in enumerate(zip(own, targets)):
            column = np.ascontiguousarray(score[:, s])
            at = np.searchsorted(who, target)
            value = column[at] if target >= 0 and at < len(who) and who[at] == target else 0.0
            column[np.searchsorted(who, mine)] = -1.0  # the set's own nodes have no rank
            tied = (column == value).sum() + (target < 0) + (n - len(who) if value == 0 else 0)
            out.append(float(1 + (column > value).sum() + (tied - 1) / 2))
        return out


def shortest(root: str, n: int, width: int, held: list[int], source: int, bits: int) -> np.ndarray | None:
    """Of every node the shortest distance from ``source`` and its fewest hops, as one number
    (units of length in the upper bits); None where that number is too small for them.

    Only nodes that came nearer move on: along their own links if these are few, else all links are read."""
    near = np.full(n, NO_PATH, np.int64)
    near[source] = 0
    parts = [(k * width, *(get(root, f"{x}{k}") for x in ("a", "w", "first", "to"))) for k in held]
    links = sum(len(p[1]) for p in parts)
    if any(len(p[2]) and p[2].max() >= 2 ** (61 - bits) for p in parts):
        return None
    changed, rounds = np.array([source]), 0
    while len(changed):
        rounds += 1
        out, size = [], 0
        for p in parts:
            low, to, first = p[0], p[4], p[3]
            mine = changed[(changed >= low) & (changed < low + width)]
            at = np.searchsorted(to, mine - low)
            there = at < len(to)
            there[there] = to[at[there]] == mine[there] - low
            at = at[there]
            ends = np.append(first[1:], len(p[1]))[at]
            out.append((mine[there], first[at], ends - first[at]))
            size += int(out[-1][2].sum())
        nearer = []
        for (low, a, w, first, to), (mine, begins, many) in zip(parts, out):
            if 4 * size > links:
                found = np.take(near, a, mode="clip")
                found += (w.astype(np.int64) << bits) + 1
                found, at = np.minimum.reduceat(found, first), low + to.astype(np.int64)
            else:
                own = np.repeat(begins - np.cumsum(many) + many, many) + np.arange(many.sum())
                found, at = np.repeat(near[mine], many) + (w[own].astype(np.int64) << bits) + 1, a[own].astype(np.int64)
            better = found < near[at]
            np.minimum.at(near, at[better], found[better])
            nearer.append(at[better])
        changed = np.unique(np.concatenate(nearer)) if nearer else changed[:0]
        if rounds * (len(parts) + 1) >= 2**bits or len(changed) and near[changed].max() >= 2**61:
            return None
    return near


class Network:
    """The stored form of layered edges (layer, src, dst, weight); :meth:`release` deletes it.

    Edges are read once and need not be distinct: a walk adds up the weights of repeated ones. With ``merge``
    they may be stored as one, which is for walks only."""

    def __init__(self, edges: DataFrame, merge: bool = False) -> None:
        self.spark = spark = edges.sparkSession
        self.root = f"{shared_dir(spark)}/strandloom/blocks-{uuid.uuid4().hex}"
        fs, target = _filesystem(spark, self.root)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        names = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
        self.node_type = names.schema["node"].dataType.simpleString()
        ends = [F.col(c).cast(self.node_type).alias(c) for c in ("src", "dst")]
        links = edges.select("layer", *ends, F.col("weight").cast("double").alias("weight"))
        parts = links.mapInArrow(_read(self.root), "part string, layers array<string>, counts array<bigint>").collect()  # one row per part
        kind = to_arrow_type(names.schema["node"].dataType)
        names = spark.range(0, 1, 1, 1).mapInArrow(_named_once(self.root, [r["part"] for r in parts], kind), f"node {self.node_type}")
        self.salt, differ = -1, False
        while not differ:  # until all hashes differ: once, but for one network in millions
            self.salt += 1
            hashed = names.select("node", F.xxhash64("node", F.lit(self.salt)).alias("h"))
            self.n, differ = hashed.mapInArrow(_number(self.root), "n bigint, differ boolean").first()
        counts: dict = {}
        for r in parts:
            for x, n in zip(r["layers"], r["counts"]):
                counts[x] = counts.get(x, 0) + n
        #: Distinct layers as a reduction counts them, with the null one.
        self.n_layers = len(counts)
        self.layers = sorted(x for x in counts if x is not None)
        n_edges = sum(counts[x] for x in self.layers)
        n_layers = max(1, len(self.layers))
        self.slots = self.n * n_layers
        self.blocks = max(1, min(self.n, max(spark.sparkContext.defaultParallelism, math.ceil(2 * n_edges / LINKS_PER_BLOCK))))
        self.width = max(1, math.ceil(self.n / self.blocks))
        self.blocks = max(1, math.ceil(self.n / self.width))
        kind = "int32" if self.slots < 2**31 else "int64"
        given = spark.sparkContext.broadcast([(r["part"], r["layers"]) for r in parts])
        placed = self._jobs(_placed(self.root, self.layers, self.width, self.blocks, kind, given), "part string, ends array<bigint>", len(parts)) if parts else []
        self._drop("read-*")
        given = spark.sparkContext.broadcast([tuple(r) for r in placed])
        done = self._jobs(_sorted(self.root, n_layers, self.width, self.slots, kind, given, merge), "block int, links bigint")
        self.held, self.links = {r[0] for r in done}, sum(r[1] for r in done)  # one row per block
        self._tabled = False
        self._drop("part-*")

    def release(self) -> None:
        fs, target = _filesystem(self.spark, self.root)
        fs.delete(target, True)

    def _drop(self, names: str) -> None:
        fs, _ = _filesystem(self.spark, self.root)
        for status in fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{names}")):
            fs.delete(status.getPath(), True)

    def _jobs(self, work: Callable, schema: str, tasks: int | None = None) -> list:
        """One task for each block, or ``tasks``; ``work`` gives rows."""
        tasks = self.blocks if tasks is None else tasks
        names = [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([row for k in pdf["id"] for row in work(int(k))], columns=names)

        return self.spark.range(0, tasks, 1, tasks).mapInPandas(run, schema).collect()

    @property
    def whole(self) -> bool:
        """Whether one task runs whole walks."""
        return self.slots <= WHOLE_SLOTS

    def _started(
        self, seeds: DataFrame, delta: float | None, taus: dict[str, float] | None = None, without_layer: str | None = None, without_node: str | None = None
    ) -> tuple:
        """(starts, names, tag, scale, change, numbers): start scores (set, slot, value) of the
        named sets, and the totals and slots of the network as it is walked, stored under ``tag``."""
        spark, root, n_layers, width, n, n_blocks, held = self.spark, self.root, max(1, len(self.layers)), self.width, self.n, self.blocks, self.held
        rows = seeds.where("set_id is not null and node is not null").select("set_id", "node", self._hash()).distinct().collect()  # the start vectors: one row per seed
        numbers = self._known(rows)
        cut_layer = self.layers.index(without_layer) if without_layer is not None else -1
        cut_node = -1
        if without_node is not None:
            cut_node = next(iter(self._numbers(spark.createDataFrame([(without_node,)], "node string")).values()), -1)
        asked = spark.sparkContext.broadcast(np.array(sorted(numbers.values()), np.int64))
        tag = uuid.uuid4().hex

        def prepare(k: int) -> list[tuple]:
            """The totals and slots of a block, and which slots of the seeds exist."""
            m = (min(n, (k + 1) * width) - k * width) * n_layers
            total, links, full = np.zeros(max(m, 0)), np.zeros(max(m, 0), np.int64), np.zeros(max(m, 0), bool)
            if k in held:
                a, w, first, to = (get(root, f"{x}{k}") for x in ("a", "w", "first", "to"))
                weight, one = np.array(w), np.ones(len(w), np.int64)
                if cut_node >= 0:
                    gone = a // n_layers == cut_node
                    weight[gone], one[gone] = 0.0, 0
                total[to], links[to], full[to] = np.add.reduceat(weight, first), np.add.reduceat(one, first), True
            there = links > 0
            grid = there.reshape(-1, n_layers)
            if cut_layer >= 0:
                grid[:, cut_layer] = False
            if cut_node >= 0 and k * width <= cut_node < (k + 1) * width:
                grid[cut_node - k * width] = False
            many = (full if cut_node >= 0 else there).reshape(-1, n_layers).sum(axis=1)
            for name, x in (("total", total), ("there", there), ("many", many.astype(np.int32))):
                put(root, f"{tag}-{name}{k}", x)
            mine = asked.value[(asked.value >= k * width) & (asked.value < (k + 1) * width)]
            rows = [(int(who), layer) for who in mine for layer in np.flatnonzero(grid[who - k * width]).tolist()]
            return [*rows, *((-1, layer) for layer in np.flatnonzero(grid.any(axis=0)).tolist())]

        found = self._jobs(prepare, "who bigint, layer int")
        alive = sorted({r[1] for r in found if r[0] < 0})
        at: dict[int, list[int]] = {}
        for who, layer in found:
            if who >= 0:
                at.setdefault(who, []).append(layer)
        sets: dict = {}
        for r in rows:
            sets.setdefault(r[0], []).append(r[1])
        names = sorted(sets)
        if delta is None:
            scale, change, share = 1.0, 0.0, None
        else:
            scale = 1 - (delta if len(alive) > 1 else 0.0)
            change = delta if cut_node >= 0 or len(alive) > 1 else 0.0
            share = {self.layers[x]: 1 / len(alive) for x in alive} if taus is None else taus
            if abs(sum(share.values()) - 1) > 1e-9 and alive or set(share) != {self.layers[x] for x in alive}:
                raise ValueError("layer weights must cover every layer and sum to one")
        starts = []  # (set, slot, value)
        for k, name in enumerate(names):
            slots = [(numbers[x], layer) for x in sets[name] if x in numbers for layer in at.get(numbers[x], ())]
            active = np.bincount([layer for _, layer in slots], minlength=n_layers)
            for who, layer in slots:
                starts.append((k, who * n_layers + layer, 1 / active[layer] if share is None else share[self.layers[layer]] / len(sets[name])))
        return starts, names, tag, scale, change, numbers

    def walk(
        self, seeds: DataFrame, restart: float, tolerance: float, rounds: int, delta: float | None = None, taus: dict[str, float] | None = None,
        without_layer: str | None = None, without_node: str | None = None, reduce: str | None = None, best: int | None = None,
    ) -> DataFrame:
        """(set_id, layer, node, score) of converged walks from ``seeds`` (set_id, node): coupled
        layers if there is a ``delta``, else one walk in each layer.

        ``without_layer`` and ``without_node`` walk on the network without them; without a
        node the weights between layers stay those of the full network. ``reduce`` gives
        (set_id, node, score) over the layers, where one task runs :attr:`whole` walks; with ``best``
        only of the nodes that can be among so many best ones beside a set's own, all ties with them."""
        from strandloom.operators.walks import NotConverged

        spark = self.spark
        kind = seeds.schema["set_id"].dataType
        starts, names, tag, scale, change, _ = self._started(seeds, delta, taus, without_layer, without_node)
        out = None
        if self.whole:
            over = reduce and (reduce, self.n_layers - (without_layer is not None))
            out = materialize(self._walk_whole(starts, names, tag, kind, restart, scale, change, tolerance, rounds, NotConverged, over, best), "walk") if names else None
            names = []
        group = max(1, SCORE_BYTES // max(1, 32 * self.slots))
        for low in range(0, len(names), group):
            mine = [(k - low, slot, p) for k, slot, p in starts if low <= k < low + group]
            part = materialize(self._converge(mine, names[low : low + group], kind, f"{tag}-{low}", tag, restart, scale, change, tolerance, rounds, NotConverged), "walk")
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = spark.createDataFrame([], self._schema(kind, not reduce))
        self._drop(f"{tag}-*")
        return out

    def ranks(self, sets: DataFrame, restart: float, tolerance: float, rounds: int, delta: float) -> DataFrame:
        """(set_id, rank): the rank of ``left_out`` in the coupled walk from the nodes of its set
        (set_id, left_out, node), of sets with a node in the network; for :attr:`whole` walks."""
        from strandloom.operators.walks import NotConverged

        kind = sets.schema["set_id"].dataType
        starts, names, tag, scale, change, numbers = self._started(sets.select("set_id", "node"), delta)
        left = dict(sets.select("set_id", "left_out").distinct().collect())  # one row per set
        numbers |= self._numbers(sets.select(F.col("left_out").alias("node")).distinct())
        targets = [numbers.get(left[x], -1) for x in names]
        of = self._grouped(starts)
        n, n_layers = self.n, max(1, self.n_layers)
        schema = f"set_id {kind.simpleString()}, rank double"
        given, arrow = self.spark.sparkContext.broadcast((names, targets)), to_arrow_type(kind)

        def told(whole: Whole, mine: list[int], scores: np.ndarray) -> Iterator[pa.RecordBatch]:
            names, targets = given.value
            own = [np.unique([slot // whole.n_layers for slot, _ in of.value[k]]) for k in mine]
            found = whole.ranks(scores, own, [targets[k] for k in mine], n, n_layers)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in mine], arrow), pa.array(found)], names=["set_id", "rank"])

        cores = self.spark.sparkContext.defaultParallelism
        group = max(1, min(16, math.ceil(len(names) / cores), WHOLE_SCORES // max(1, self.slots)))
        work = self._whole_work(of, len(names), group, math.ceil(len(names) / group / cores), tag, restart, scale, change, tolerance, rounds, NotConverged, told)
        out = materialize(work(schema), "ranks")
        self._drop(f"{tag}-*")
        return out

    def distances(self, sources: DataFrame) -> DataFrame | None:
        """(source, node, distance, hops) from each of ``sources`` (node) on a network whose
        weights are lengths in units of 1e-9; None if distance and hops do not fit one number."""
        spark, root, n, width, held, bits = self.spark, self.root, self.n, self.width, sorted(self.held), HOP_BITS
        asked = sources.select("node").distinct()
        numbers = self._numbers(asked)
        alone = [(r[0], r[0], 0.0, 0) for r in asked.collect() if r[0] not in numbers]  # one row per source
        given = spark.sparkContext.broadcast(sorted(numbers.values()))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = names_of(root)
            for source in (given.value[k] for batch in batches for k in batch.column("id").to_pylist()):
                near = shortest(root, n, width, held, source, bits)
                at = np.flatnonzero(near < NO_PATH) if near is not None else np.array([source])
                for low in range(0, len(at), ROWS_PER_BATCH):
                    here = at[low : low + ROWS_PER_BATCH]
                    length, hops = (near[here] >> bits, near[here] & (2**bits - 1)) if near is not None else (here, here * 0 - 1)
                    columns = {"source": names.take(pa.array(np.full(len(here), source))), "node": names.take(pa.array(here)), "distance": pa.array(length / 1e9)}
                    yield pa.RecordBatch.from_pydict(columns | {"hops": pa.array(hops.astype(np.int32))})

        schema = f"source {self.node_type}, node {self.node_type}, distance double, hops int"
        rows = spark.createDataFrame(alone, schema)
        if numbers:
            found = materialize(spark.range(0, len(numbers), 1, len(numbers)).mapInArrow(work, schema), "dist")
            if not found.where("hops < 0").isEmpty():
                return None
            rows = found.unionByName(rows) if alone else found
        return rows

    def _schema(self, kind: DataType, layered: bool) -> str:
        return f"set_id {kind.simpleString()}, " + "layer string, " * layered + f"node {self.node_type}, score double"

    def _numbers(self, asked: DataFrame) -> dict:
        """The numbers of some nodes (node) that the network has."""
        return self._known(asked.select("node", self._hash()).collect())

    def _hash(self) -> Column:
        return F.xxhash64(F.col("node").cast(self.node_type), F.lit(self.salt)).alias("h")

    def _known(self, asked: list) -> dict:
        """The numbers of rows with (node, h) that the network has."""
        asked = list({r["node"]: r for r in asked}.values())
        every, names = np.array(get(self.root, "nodes")), names_of(self.root)
        at = np.searchsorted(every, np.array([r["h"] for r in asked], np.int64)).tolist()
        found = zip(asked, at, names.take(pa.array(np.minimum(at, len(every) - 1).astype(np.int64))).to_pylist() if len(every) else [None] * len(at))
        return {r["node"]: k for r, k, name in found if k < len(every) and every[k] == r["h"] and str(name) == str(r["node"])}

    def _groups(self, sets: int) -> int:
        """Seed sets that one task walks at a time."""
        cores = self.spark.sparkContext.defaultParallelism
        return max(1, min(16, math.ceil(sets / cores), WHOLE_SCORES // max(1, self.slots)))

    def _grouped(self, starts: list):
        """The start scores of each set, for all tasks."""
        by_set: dict[int, list] = {}
        for k, slot, value in starts:
            by_set.setdefault(k, []).append((slot, value))
        return self.spark.sparkContext.broadcast(by_set)

    def _whole_work(
        self, of: Broadcast, n_sets: int, group: int, each: int, tag: str, restart: float, scale: float, change: float, tolerance: float, rounds: int,
        failure: type, told: Callable,
    ) -> Callable:
        """Runs whole walks of ``group`` sets at a time, ``each`` times in a task on one copy of the
        links, and gives what ``told`` makes of (network, sets, scores)."""
        spark, root, held = self.spark, self.root, self.held
        shape, most = (self.n, max(1, len(self.layers)), self.width, self.blocks), WHOLE_LINKS
        self._store_tables(of, tag, rounds, change)
        parts = math.ceil(n_sets / (group * each))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (g for batch in batches for g in batch.column("id").to_pylist()):
                every = [k for k in range(part * group * each, min((part + 1) * group * each, n_sets)) if k in of.value]
                if not every:
                    continue
                slots = np.array([slot for k in every for slot, _ in of.value[k]], np.int64)
                whole = Whole(root, tag, shape, held, slots, rounds, scale, change, min(group, len(every)), most)
                for low in range(0, len(every), group):
                    mine = every[low : low + group]
                    p0 = np.zeros((len(whole.slots), len(mine)))
                    for s, k in enumerate(mine):
                        for slot, value in of.value[k]:
                            p0[whole.place[slot], s] = value
                    yield from told(whole, mine, whole.walk(p0, restart, tolerance, rounds, failure))

        return lambda schema: spark.range(0, parts, 1, parts).mapInArrow(work, schema)

    def _store_tables(self, of: Broadcast, tag: str, rounds: int, change: float) -> None:
        """Stores the links in tables, once, if walks reach too many of them for one task."""
        root, held, n, n_layers, width, blocks, most = self.root, self.held, self.n, max(1, len(self.layers)), self.width, self.blocks, WHOLE_LINKS
        if self._tabled or self.links <= most:
            return

        def reach(_: int) -> list[tuple]:
            there, many = (np.concatenate([get(root, f"{tag}-{x}{k}") for k in range(blocks)]) for x in ("there", "many"))
            starts = np.array([slot for mine in of.value.values() for slot, _ in mine], np.int64)
            if reached(root, sorted(held), width * n_layers, n_layers, there, many, starts, rounds, change, most) is not None:
                return []
            order, hubs = ordered(root, n, width, held)
            put(root, "order", order)
            return [(hubs,)]

        far = self._jobs(reach, "hubs bigint", 1)
        if not far:
            return
        hubs, self._tabled = far[0][0], True

        def store(k: int) -> list[tuple]:
            for x, values in enumerate(tabled(root, k, n_layers, width, get(root, "order"), hubs) if k in held else ()):
                put(root, f"table{x}{k}", values)
            return []

        self._jobs(store, "block int")

    def _walk_whole(
        self, starts: list, names: list, tag: str, kind: DataType, restart: float, scale: float, change: float, tolerance: float, rounds: int, failure: type,
        reduce: tuple | None = None, best: int | None = None,
    ) -> DataFrame:
        named, of = self._named(names, kind, not reduce), self._grouped(starts)

        def told(whole: Whole, mine: list[int], scores: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s, k in enumerate(mine):
                column = np.ascontiguousarray(scores[:, s])
                if reduce:
                    who, value = whole.reduced(column, *reduce)
                    last = len(value) - (best or len(value)) - len({slot // whole.n_layers for slot, _ in of.value[k]})
                    if last > 0:
                        some = value >= np.partition(value, last)[last] - BEST_MARGIN
                        who, value = who[some], value[some]
                    yield from named(k, who, value)
                else:
                    some = np.flatnonzero(column)
                    yield from named(k, whole.slots[some], column[some])

        group = self._groups(len(names))
        work = self._whole_work(of, len(names), group, 1, tag, restart, scale, change, tolerance, rounds, failure, told)
        return work(self._schema(kind, not reduce))

    def _named(self, names: list, kind: DataType, layered: bool) -> Callable:
        """Makes rows with names of (set, slots or nodes, scores)."""
        root, n_layers, known, arrow = self.root, max(1, len(self.layers)), self.layers, to_arrow_type(kind)

        def rows(k: int, at: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
            every, layers = names_of(root), pa.array(known, pa.string())
            for low in range(0, len(at), ROWS_PER_BATCH):
                here, score = at[low : low + ROWS_PER_BATCH], scores[low : low + ROWS_PER_BATCH]
                columns = {"set_id": pa.array([names[k]], arrow).take(pa.array(np.zeros(len(here), np.int32)))}
                if layered:
                    columns["layer"] = layers.take(pa.array(here % n_layers))
                    here = here // n_layers
                columns |= {"node": every.take(pa.array(here)), "score": pa.array(score)}
                yield pa.RecordBatch.from_pydict(columns)

        return rows

    def _converge(self, starts: list, names: list, kind: DataType, at: str, tag: str, restart: float, scale: float, change: float, tolerance: float, rounds: int, failure: type) -> DataFrame:
        spark, root, n_layers, width, n, n_blocks, held = self.spark, self.root, max(1, len(self.layers)), self.width, self.n, self.blocks, self.held
        n_slots, n_sets = self.slots, len(names)
        given = spark.sparkContext.broadcast(tuple(np.array([s[c] for s in starts], kind) for c, kind in ((0, np.int64), (1, np.int64), (2, float))))

        def own(k: int) -> tuple:
            """(start scores, totals, slots there, chance to change layer) of a block."""
            total, there, many = (np.array(get(root, f"{tag}-{x}{k}")) for x in ("total", "there", "many"))
            k_set, slot, value = given.value
            mine = (slot >= k * width * n_layers) & (slot < (k + 1) * width * n_layers)
            p0 = np.zeros((n_sets, len(total)))
            p0[k_set[mine], slot[mine] - k * width * n_layers] = value[mine]
            return p0, total, there, np.where(many > 1, change / np.maximum(many - 1, 1), 0.0)

        def keep(k: int, r: int, reached: np.ndarray, now: np.ndarray, total: np.ndarray) -> None:
            """Scores after a round; those two rounds older give way."""
            slots = np.flatnonzero(reached)
            scores = now[:, slots]
            put(root, f"{at}-slots{r % 2}-{k}", slots.astype(np.int32))
            put(root, f"{at}-now{r % 2}-{k}", scores)
            put(root, f"{at}-sent{r % 2}-{k}", scores / np.where(total[slots] == 0, np.nan, total[slots]))

        def begin(k: int) -> list[tuple]:
            p0, total, _, _ = own(k)
            keep(k, 0, (p0 > 0).any(axis=0), p0, total)
            return [(k, int((p0 > 0).any(axis=0).sum()), [0.0] * n_sets)]

        def links_of(k: int, active: np.ndarray, settled: bool) -> tuple:
            """The block's links from slots with a score. Once no slot is added, they are kept."""
            fs, path = _opened(root)
            if settled and fs.get_file_info(f"{path}/{at}-to{k}.npy").type != pafs.FileType.NotFound:
                return tuple(get(root, f"{at}-{x}{k}") for x in ("a", "w", "first", "to"))
            a, w, first, to = (get(root, f"{x}{k}") for x in ("a", "w", "first", "to"))
            used = active[a]
            if used.all():
                return a, w, first, to
            before = np.r_[0, np.cumsum(used)]
            begins, ends = before[first], before[np.r_[first[1:], len(a)]]
            some = ends > begins
            few = a[used], w[used], begins[some], to[some]
            if settled and 2 * len(few[0]) < len(a):
                for x, values in zip(("a", "w", "first", "to"), few):
                    put(root, f"{at}-{x}{k}", values)
            return few

        def step(r: int, settled: bool) -> Callable:
            def run(k: int) -> list[tuple]:
                p0, total, there, chance = own(k)
                m, before = len(total), (r - 1) % 2
                now, after, reached = np.zeros((n_sets, m)), np.zeros((n_sets, m)), (p0 > 0).any(axis=0)
                old = get(root, f"{at}-slots{before}-{k}")
                now[:, old] = get(root, f"{at}-now{before}-{k}")
                if k in held:
                    parts = [(q * width * n_layers + get(root, f"{at}-slots{before}-{q}").astype(np.int64), get(root, f"{at}-sent{before}-{q}")) for q in range(n_blocks)]
                    active = np.zeros(n_slots, bool)
                    for slots, _ in parts:
                        active[slots] = True
                    a, w, first, to = links_of(k, active, settled)
                    if len(a):
                        reached[to] = True
                        for s in range(n_sets):
                            sent = np.zeros(n_slots)
                            for slots, values in parts:
                                sent[slots] = values[s]
                            after[s, to] = np.add.reduceat(sent[a] * w, first) * scale
                if change:
                    here = np.zeros(m, bool)
                    here[old] = True
                    here = here.reshape(-1, n_layers) & (chance > 0)[:, None]
                    reached |= (here.sum(axis=1, keepdims=True) > here).ravel()
                    move = now.reshape(n_sets, -1, n_layers) * chance[:, None]
                    after += (move.sum(axis=2, keepdims=True) - move).reshape(n_sets, m)
                reached &= there
                after = np.where(reached, (1 - restart) * after + restart * p0, 0.0)
                keep(k, r, reached, after, total)
                return [(k, int(reached.sum()), np.abs(after - now).sum(axis=1).tolist())]

            return run

        schema = "block int, reached bigint, off array<double>"
        reached, settled = sum(r[1] for r in self._jobs(begin, schema)), False
        for r in range(1, rounds + 1):
            done = self._jobs(step(r, settled), schema)
            off = np.sum([x[2] for x in done], axis=0).max(initial=0.0)
            settled, reached = sum(x[1] for x in done) == reached, sum(x[1] for x in done)
            if off < tolerance:
                break
        else:
            raise failure(f"a walk still changed by {off:g} after {rounds} rounds")
        parity = r % 2

        named = self._named(names, kind, True)

        def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k in (k for batch in batches for k in batch.column("id").to_pylist()):
                slots, now = get(root, f"{at}-slots{parity}-{k}").astype(np.int64) + k * width * n_layers, get(root, f"{at}-now{parity}-{k}")
                for s in range(n_sets):
                    yield from named(s, slots, np.array(now[s]))

        return spark.range(0, n_blocks, 1, n_blocks).mapInArrow(result, self._schema(kind, True))
