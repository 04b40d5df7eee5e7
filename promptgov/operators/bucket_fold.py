"""The Python part of the token bucket: folds over rows already partitioned and
sorted by Spark. Each function maps Arrow batches to Arrow batches, keeps the state
of one chunk or one tenant, and reads a chunk that spans batches as one.

Time is in microseconds. NEVER is the last refill of a bucket not yet made; the
first ask then counts as a refill of any length, which leaves it full.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from itertools import zip_longest
from operator import itemgetter

import numpy as np
import pyarrow as pa

MINUTE = 60_000_000
NEVER = -(1 << 62)

# Row kinds. ENTRY says what a chunk starts from, SET what a tenant does.
ENTRY, ASK, RESET, EXEMPT, SET = 0, 1, 2, 3, 4
# Stands for the end of time.
ALWAYS = 1 << 62
# Stands for the chunk in rows that lead a group of chunks.
LEAD = -1


def _values(column):
    """A column without nulls as a list; by way of numpy, far faster than to_pylist."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        encoded = column.dictionary_encode()
        words = encoded.dictionary.to_pylist()
        return [words[i] for i in encoded.indices.to_numpy(zero_copy_only=False).tolist()]
    return column.to_numpy(zero_copy_only=False).tolist()


def _rows(batches, *names):
    for batch in batches:
        yield from zip(*(_values(batch.column(n)) for n in names))


def _emit(rows, schema):
    """Arrow batches of bounded size from an iterator of tuples."""
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) == 50_000:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows, schema):
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


# -- when buckets refill ----------------------------------------------------

FILL_MAP = pa.schema([
    ("__tenant", pa.string()), ("__chunk", pa.int64()), ("__upto", pa.int64()), ("__fill", pa.int64()),
])


class _FillChunk:
    """For one chunk: the last refill at its end, as a function of the one before it.

    Refills depend on time alone: a row refills if a minute has passed since the
    last refill. Every row in the chunk's first minute may be the first to refill,
    depending on the refill before; each is followed as a path, and paths that meet
    are joined. `upto[i]` is the latest earlier refill that starts path i. No refill
    before the chunk is later than `start`: the time of its first row, or ALWAYS where a
    tenant may have a refill later than its rows.
    """

    def __init__(self, start):
        self.start = start
        self.upto, self.parent, self.at = [], [], []
        self.queue = deque()

    def _root(self, path):
        while self.parent[path] != path:
            self.parent[path] = path = self.parent[self.parent[path]]
        return path

    def _new_path(self, upto):
        self.upto.append(upto)
        self.parent.append(len(self.parent))
        self.at.append(NEVER)
        return len(self.upto) - 1

    def ask(self, us):
        limit = us - MINUTE
        due = []
        while self.queue and self.at[self.queue[0]] <= limit:
            due.append(self.queue.popleft())
        if not self.upto or (self.upto[-1] < self.start and self.upto[-1] < limit):
            due.append(self._new_path(limit))
        self._join(due, us)

    def reset(self, fill=NEVER):
        """From here on `fill` is the last refill, whatever came before."""
        paths = list(self.queue)
        self.queue.clear()
        if not self.upto or self.upto[-1] < self.start:
            paths.append(self._new_path(self.start))
        self._join(paths, fill)

    def _join(self, paths, at):
        if paths:
            for path in paths[1:]:
                self.parent[path] = paths[0]
            self.at[paths[0]] = at
            self.queue.append(paths[0])

    def pieces(self):
        """(upto, last refill), neighbours with the same outcome merged."""
        ends = [self.at[self._root(i)] for i in range(len(self.upto))]
        for i, (upto, end) in enumerate(zip(self.upto, ends)):
            if i + 1 == len(ends) or ends[i + 1] != end:
                yield upto, end


def fill_maps(late):
    """(tenant, chunk, us, kind, since), sorted -> the pieces of each chunk's refill function.

    `late` tells that a tenant may start from a refill later than its rows.
    """

    def rows(batches):
        key, state = None, None
        for tenant, chunk, us, kind, since in _rows(batches, "__tenant", "__chunk", "__us", "__kind", "__since"):
            if key != (tenant, chunk):
                if state:
                    yield from ((*key, *piece) for piece in state.pieces())
                key, state = (tenant, chunk), _FillChunk(ALWAYS if late else us)
            if kind == ASK:
                state.ask(us)
            else:
                state.reset(since if kind == SET else NEVER)
        if state:
            yield from ((*key, *piece) for piece in state.pieces())

    return lambda batches: _emit(rows(batches), FILL_MAP)


FILL_ENTRY = pa.schema([
    ("__tenant", pa.string()), ("__chunk", pa.int64()), ("__fill", pa.int64()),
])


def _functions(batches, *names):
    """Rows sorted by (tenant, group, chunk, upto) -> (tenant, group, chunk, rows of that function)."""
    key, held = None, []
    for tenant, group, chunk, *row in _rows(batches, "__tenant", "__group", "__chunk", *names):
        if key != (tenant, group, chunk):
            if held:
                yield *key, held
            key, held = (tenant, group, chunk), []
        held.append(row)
    if held:
        yield *key, held


def _fill_after(pieces, fill):
    """A refill later than all pieces stays the last one."""
    at = bisect_left(pieces, fill, key=itemgetter(0))
    return pieces[at][1] if at < len(pieces) else fill


def fill_entries(batches):
    """Pieces sorted by (tenant, group, chunk, upto) -> the refill time each chunk starts from.

    A group may be led by a row with chunk LEAD that holds the refill it starts from.
    """

    def rows():
        group_now, fill = None, NEVER
        for tenant, group, chunk, pieces in _functions(batches, "__upto", "__fill"):
            if (tenant, group) != group_now:
                group_now, fill = (tenant, group), NEVER
            if chunk == LEAD:
                fill = pieces[0][1]
                continue
            yield tenant, chunk, fill
            fill = _fill_after(pieces, fill)

    return _emit(rows(), FILL_ENTRY)


def fill_compose(batches):
    """Pieces sorted by (tenant, group, chunk, upto) -> the pieces of each group as one function."""

    def rows():
        group_now, whole = None, []
        for tenant, group, _, pieces in _functions(batches, "__upto", "__fill"):
            if (tenant, group) != group_now:
                if group_now:
                    yield from ((*group_now, *piece) for piece in whole)
                group_now, whole = (tenant, group), pieces
                continue
            last = whole[-1][0]
            both = [(upto, _fill_after(pieces, end)) for upto, end in whole]
            both += [(upto, end) for upto, end in pieces if upto > last]
            whole = [p for p, after in zip_longest(both, both[1:]) if after is None or after[1] != p[1]]
        if group_now:
            yield from ((*group_now, *piece) for piece in whole)

    return _emit(rows(), FILL_MAP)


# -- how balances carry over ------------------------------------------------

BALANCE_MAP = pa.schema([
    ("__tenant", pa.string()), ("__chunk", pa.int64()), ("__fill", pa.int64()),
    ("__upto", pa.int64()), ("__balance", pa.int64()), ("__slope", pa.int64()),
])


class _BalanceChunk:
    """For one chunk: the balance at its end, as a function of the one before it.

    All balances from 0 to the capacity are followed at once, as stretches of starting
    balances: stretch i ends at `upto[i]` and has reached image `which[i]`. An image is a run
    of balances, `low` to `low + size`; with size 0 its whole stretch has reached one balance.
    An ask cuts the images it falls into, a refill those that it fills; stretches with equal
    images share one. So the work depends on the number of images, not on the capacity. A full
    bucket makes all balances meet; then a single number is left.
    """

    def __init__(self, fill, rate, capacity):
        self.fill, self.rate, self.capacity = fill, rate, capacity
        self.single = 0 if capacity == 0 else None
        self.upto, self.which = np.array([capacity]), np.array([0])
        self.lows, self.sizes = np.array([0]), np.array([capacity])
        self.low, self.high = 0, capacity
        self.tidy = 64  # so many images are made before equal ones are looked for

    def ask(self, us, tokens):
        minutes = (us - self.fill) // MINUTE
        if minutes > 0:
            self.fill = us
            self._refill(minutes * self.rate)
        if self.single is not None:
            if tokens <= self.single:
                self.single -= tokens
        elif 0 < tokens <= self.high:
            self._spend(tokens)

    def reset(self):
        self.fill, self.single = NEVER, self.capacity

    def set(self, fill, balance):
        self.fill, self.single = fill, min(balance, self.capacity)

    def _refill(self, added):
        if self.single is not None:
            self.single = min(self.capacity, self.single + added)
        elif self.low + added >= self.capacity:
            self.single = self.capacity
        else:
            self.lows = self.lows + added
            if self.high + added > self.capacity:
                self._cut(self.capacity + 1)
                over = self.lows > self.capacity
                self.lows[over], self.sizes[over] = self.capacity, 0
            self._settle()

    def _spend(self, tokens):
        if tokens > self.low:
            self._cut(tokens)
        self.lows = np.where(self.lows >= tokens, self.lows - tokens, self.lows)
        self._settle()

    def _cut(self, at):
        """Cut images with balances on both sides of `at`, and the stretches that reached them."""
        cut = (self.lows < at) & (self.lows + self.sizes >= at)
        if not cut.any():
            return
        upper = self.lows[cut] + self.sizes[cut] - at
        twice = cut[self.which]
        second = len(self.lows) + np.cumsum(cut) - 1  # the image that gets the upper part
        places = np.cumsum(1 + twice) - 1
        which, upto = np.repeat(self.which, 1 + twice), np.repeat(self.upto, 1 + twice)
        which[places[twice]] = second[self.which[twice]]
        lengths = (self.lows + self.sizes - at + 1)[self.which[twice]]
        upto[places[twice] - 1] = self.upto[twice] - lengths
        self.which, self.upto = which, upto
        self.sizes = np.concatenate([np.where(cut, at - 1 - self.lows, self.sizes), upper])
        self.lows = np.concatenate([self.lows, np.full(len(upper), at)])

    def _settle(self):
        if len(self.lows) > self.tidy:
            images, where = np.unique(np.stack([self.lows, self.sizes]), axis=1, return_inverse=True)
            (self.lows, self.sizes), self.which = images, where.reshape(-1)[self.which]
            ends = np.r_[(self.which[1:] != self.which[:-1]) | (self.sizes[self.which[1:]] > 0), True]
            self.upto, self.which = self.upto[ends], self.which[ends]
            self.tidy = 2 * len(self.lows) + 64
        self.low, self.high = int(self.lows.min()), int((self.lows + self.sizes).max())
        if self.low == self.high:
            self.single = self.low

    def pieces(self):
        """(upto, balance, slope): from `upto` down to the piece before, the end balance
        is `balance` less `slope` for each token below `upto`."""
        if self.single is not None:
            return [(self.capacity, self.single, 0)]
        sizes = self.sizes[self.which]
        ends = self.lows[self.which] + sizes
        return _joined(zip(self.upto.tolist(), ends.tolist(), (sizes > 0).astype(int).tolist()))


def _joined(pieces):
    """Neighbours that go on alike as one piece."""
    out = []
    for upto, end, slope in pieces:
        if out and out[-1][2] == slope and out[-1][1] == end - slope * (upto - out[-1][0]):
            out.pop()
        out.append((upto, end, slope))
    return out


def balance_maps(batches):
    """(tenant, chunk, us, kind, ask, since, fill, rate, capacity), sorted, each chunk led by its ENTRY
    row -> the pieces of each chunk's balance function.

    Rate and capacity are those of the chunk's first row: they belong to the tenant.
    """

    def rows():
        key, fill, state = None, None, None
        for batch in batches:
            tenants, chunks = batch.column("__tenant"), batch.column("__chunk")
            rates, capacities = batch.column("__rate"), batch.column("__capacity")
            columns = (_values(batch.column(n)) for n in ("__us", "__kind", "__ask", "__since", "__fill"))
            for i, (us, kind, tokens, since, entry_fill) in enumerate(zip(*columns)):
                if kind == ENTRY:
                    if state:
                        yield from ((*key, fill, *piece) for piece in state.pieces())
                    key, fill, state = (tenants[i].as_py(), chunks[i].as_py()), entry_fill, None
                    continue
                if state is None:
                    state = _BalanceChunk(fill, rates[i].as_py(), capacities[i].as_py())
                if kind == ASK:
                    state.ask(us, tokens)
                elif kind == SET:
                    state.set(since, tokens)
                else:
                    state.reset()
        if state:
            yield from ((*key, fill, *piece) for piece in state.pieces())

    return _emit(rows(), BALANCE_MAP)


ENTRIES = pa.schema([
    ("__tenant", pa.string()), ("__chunk", pa.int64()), ("__fill", pa.int64()), ("__balance", pa.int64()),
])


def _balance_after(pieces, balance):
    upto, end, slope = pieces[bisect_left(pieces, balance, key=itemgetter(0))]
    return end - slope * (upto - balance)


def balance_entries(batches):
    """Pieces sorted by (tenant, group, chunk, upto) -> refill time and balance at each start.

    A group may be led by a row with chunk LEAD that holds the balance it starts from; without one
    the bucket is full: the last piece ends at its capacity.
    """

    def rows():
        group_now, balance = None, None
        for tenant, group, chunk, found in _functions(batches, "__fill", "__upto", "__balance", "__slope"):
            if (tenant, group) != group_now:
                group_now, balance = (tenant, group), found[-1][1]
            if chunk == LEAD:
                balance = found[0][2]
                continue
            yield tenant, chunk, found[0][0], balance
            balance = _balance_after([p[1:] for p in found], balance)

    return _emit(rows(), ENTRIES)


def _balance_through(whole, pieces):
    """The pieces of `whole` followed by `pieces`."""
    start = 0
    for upto, end, slope in whole:
        low = end - slope * (upto - start)
        at = bisect_left(pieces, low, key=itemgetter(0))
        while True:  # the pieces that the balances from low to end fall into
            last, after, step = pieces[at]
            top = min(last, end)
            yield upto - (end - top), after - step * (last - top), step * slope
            if top == end:
                break
            at += 1
        start = upto + 1


def balance_compose(batches):
    """Pieces sorted by (tenant, group, chunk, upto) -> the pieces of each group as one function."""

    def rows():
        group_now, whole = None, []
        for tenant, group, _, found in _functions(batches, "__upto", "__balance", "__slope"):
            if (tenant, group) != group_now:
                if group_now:
                    yield from ((*group_now, 0, *piece) for piece in whole)
                group_now, whole = (tenant, group), found
            else:
                whole = _joined(_balance_through(whole, found))
        if group_now:
            yield from ((*group_now, 0, *piece) for piece in whole)

    return _emit(rows(), BALANCE_MAP)


# -- decisions --------------------------------------------------------------


def step(fill, balance, us, tokens, rate, capacity):
    """One ask: the new refill time and balance, and whether it is allowed."""
    minutes = (us - fill) // MINUTE
    if minutes > 0:
        fill, balance = us, min(capacity, balance + minutes * rate)
    if tokens <= balance:
        return fill, balance - tokens, True
    return fill, balance, False


def decide(keep, state):
    """Sorted rows -> the columns `keep` with `allowed`, `remaining` and, if `state` names one, a column of
    the last refill. ENTRY and SET rows, which are not returned, say what a tenant's chunk and
    a tenant start from; without them the bucket is new."""

    def run(batches):
        tenant_now, fill, balance = None, NEVER, 0
        for batch in batches:
            allowed, remaining, filled, mask = [], [], [], []
            names = ("__us", "__kind", "__ask", "__since", "__rate", "__capacity", "__fill", "__balance")
            columns = (_values(batch.column(n)) for n in names)
            tenants = _values(batch.column("__tenant").fill_null(""))
            for tenant, us, kind, tokens, since, rate, capacity, entry_fill, entry_balance in zip(tenants, *columns):
                mask.append(kind != ENTRY and kind != SET)
                if kind == ENTRY:
                    tenant_now, fill, balance = tenant, entry_fill, entry_balance
                    continue
                if tenant != tenant_now and kind != EXEMPT:
                    tenant_now, fill, balance = tenant, NEVER, capacity
                if kind == ASK:
                    fill, balance, ok = step(fill, balance, us, tokens, rate, capacity)
                    allowed.append(ok)
                    remaining.append(balance)
                    filled.append(fill)
                elif kind == SET:
                    fill, balance = since, min(tokens, capacity)
                elif kind == RESET:
                    fill, balance = NEVER, capacity
                    allowed.append(None)
                    remaining.append(capacity)
                    filled.append(NEVER)
                else:
                    allowed.append(True)
                    remaining.append(None)
                    filled.append(None)
            rows = batch.filter(pa.array(mask, pa.bool_()))
            if rows.num_rows:
                own = [pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(filled, pa.int64())]
                more = ["allowed", "remaining", state][:3 if state else 2]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(n) for n in keep] + own[:len(more)], names=[*keep, *more])

    return run
