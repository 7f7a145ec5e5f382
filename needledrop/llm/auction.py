"""Cheapest repair of a sequence of turns: an auction over a lattice of rows and states.

A node is a place between rows and a state (what the turns kept so far end with); an arc is an edit of the
next row, or an inserted turn. Bertsekas' auction finds the shortest path: node prices start at what the layers ahead cost at least, a path
grows from the origin along the arc of least cost plus price, and where the price of its end is below that
sum, the price rises to it and the path is shortened by one node. Prices never break price(i) <= cost(i, j)
+ price(j), so when the path arrives, every cheapest path consists of tight arcs (equality), and the tight
arcs that lead to the end are followed by their letters, the smallest first.

Long sequences are auctioned in blocks: a block's costs from state to state are one layer of a coarser
lattice, level by level, and prices at the bounds of the blocks come down the same way.
"""

from __future__ import annotations

from functools import lru_cache

# States: nothing yet, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60  # no way

# What edits cost.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# A row's code is 4 * fault + initial; the last code ends the conversation.
SOUND, DOOMED, CUT = range(3)  # DOOMED rows must go; CUT rows cost more when they stay
INITIALS = "sua"  # any other initial is 3
END = 12
_BLOCK = 16

_NEXT = (USER, USER, ASSISTANT, USER)  # what may follow a state, but for the system turn

Arc = tuple[int, str, int, int]  # cost, letter, layers ahead, state


def row_code(role: str, fault: int) -> int:
    initial = INITIALS.find(role[:1]) if role else -1
    return 4 * fault + (initial if initial >= 0 else 3)


def _arcs(code: int) -> tuple[tuple[Arc, ...], ...]:
    """The arcs of one layer, by state."""
    out: list[list[Arc]] = [[(INSERT, "I", 0, _NEXT[s])] for s in STATES]
    if code == END:
        for s in (START, ASSISTANT):
            out[s].append((0, "", 1, START))
        return tuple(map(tuple, out))
    fault, initial = divmod(code, 4)
    more = TRUNCATED * (fault == CUT)
    for s in STATES:
        out[s].append((DELETE, "D", 1, s))
        if fault != DOOMED:
            if initial == 0 and s == START:
                out[s].append((more, "K", 1, SYSTEM))
            if initial == {USER: 1, ASSISTANT: 2}[_NEXT[s]]:
                out[s].append((more, "K", 1, _NEXT[s]))
            out[s].append((RENAME + more, "R", 1, _NEXT[s]))
    return tuple(map(tuple, out))


_LAYERS = [_arcs(code) for code in range(END + 1)]


def _graph(layers: list, costs: tuple[int, ...]) -> tuple[list[list[tuple[int, str, int]]], list[list[int]], int]:
    """(arcs, nodes before each node, end) of some layers, with ``costs`` from the last states to the end.

    Nodes that cannot reach the end are left out, so that no price can rise for ever.
    """
    end = 4 * len(layers) + 4
    arcs: list[list[tuple[int, str, int]]] = [
        [(cost, letter, 4 * (at + ahead) + to) for cost, letter, ahead, to in layer[s]] for at, layer in enumerate(layers) for s in STATES
    ]
    arcs += [[(costs[s], "", end)] if costs[s] < FAR else [] for s in STATES]
    arcs.append([])
    before: list[list[int]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for _, _, to in out:
            before[to].append(node)
    seen = _back(before, end, lambda node, to: True)
    arcs = [[a for a in out if seen[a[2]]] for out in arcs]
    return arcs, before, end


def _back(before: list[list[int]], end: int, along) -> list[bool]:
    """The nodes from which ``end`` is reached along chosen arcs."""
    seen, todo = [False] * len(before), [end]
    seen[end] = True
    while todo:
        to = todo.pop()
        for node in before[to]:
            if not seen[node] and along(node, to):
                seen[node] = True
                todo.append(node)
    return seen


def _opening(layers: list, costs: tuple[int, ...]) -> list[int]:
    """Prices to start from: what the layers ahead cost at least. Equal within a layer, so no arc breaks the rule."""
    ahead = [min(costs)]
    for layer in reversed(layers):
        ahead.append(ahead[-1] + min((a[0] for out in layer for a in out if a[2]), default=0))
    return [p for p in reversed(ahead) for _ in STATES] + [0]


def _auction(arcs: list, price: list[int], origin: int, end: int) -> int:
    """Raise prices until the cheapest path from ``origin`` is known; returns its cost."""
    if not arcs[origin] and origin != end:
        return FAR
    path = [origin]
    while (node := path[-1]) != end:
        least, best = FAR, -1
        for cost, _, to in arcs[node]:
            if cost + price[to] < least:
                least, best = cost + price[to], to
        if price[node] < least:
            price[node] = least  # contraction
            if len(path) > 1:
                path.pop()
        else:
            path.append(best)  # extension
    return price[origin]


@lru_cache(maxsize=1 << 16)
def _crossing(block: tuple) -> tuple:
    """The costs from state to state across some layers, as one layer."""
    layers = [_LAYERS[x] if isinstance(x, int) else x for x in block]
    out: list[list[Arc]] = [[] for _ in STATES]
    for to in STATES:
        costs = tuple(0 if s == to else FAR for s in STATES)
        arcs, _, end = _graph(layers, costs)
        price = _opening(layers, costs)
        for s in STATES:
            # Prices that one origin has raised hold for the others.
            cost = _auction(arcs, price, s, end)
            if cost < FAR:
                out[s].append((cost, "", 1, to))
    return tuple(map(tuple, out))


def _prices(layers: list, entries, costs: tuple[int, ...]):
    """(arcs, price, lies on a tight way to the end) after auctions from some states of the first layer."""
    arcs, before, end = _graph(layers, costs)
    price = _opening(layers, costs)
    for s in entries:
        _auction(arcs, price, s, end)
    tight = _back(before, end, lambda node, to: any(a[2] == to and price[node] == a[0] + price[to] for a in arcs[node]))
    return arcs, price, tight, end


def crossing(items) -> tuple:
    """The costs from state to state across codes or layers, as one layer."""
    level = tuple(items)
    while len(level) > _BLOCK:
        level = tuple(_crossing(level[i : i + _BLOCK]) for i in range(0, len(level), _BLOCK))
    return _crossing(level)


def bounds(items, entries, costs: tuple[int, ...], every: int = 1) -> list[tuple[int, ...]]:
    """Costs to go by state before each ``every``-th item (1 or a block) and after the last one.

    States that no cheapest way from the ``entries`` passes may be FAR.
    """
    levels = [tuple(items)]
    while len(levels[-1]) > _BLOCK:
        levels.append(tuple(_crossing(levels[-1][i : i + _BLOCK]) for i in range(0, len(levels[-1]), _BLOCK)))

    def inside(level: tuple, entries, costs: tuple[int, ...]) -> list[tuple[int, ...]]:
        layers = [_LAYERS[x] if isinstance(x, int) else x for x in level]
        _, price, tight, _ = _prices(layers, entries, costs)
        found = [tuple(price[4 * i + s] if tight[4 * i + s] else FAR for s in STATES) for i in range(len(layers))]
        return [*found, costs]

    found = inside(levels[-1], entries, costs)
    for level in reversed(levels[:-1]):
        if level is levels[0] and every > 1:
            break
        finer: list[tuple[int, ...]] = []
        for at, i in enumerate(range(0, len(level), _BLOCK)):
            live = [s for s in STATES if found[at][s] < FAR]
            finer += inside(level[i : i + _BLOCK], live, found[at + 1])[:-1]
        found = [*finer, found[-1]]
    return found


def trace(codes: bytes, entry: int, costs: tuple[int, ...], known: list | None = None) -> tuple[str, int]:
    """(letters, last state) of the least of the cheapest edits of some rows, from a state to the costs after them.

    ``known`` are the costs to go at the bounds of the blocks, if they are at hand.
    """
    blocks = [codes[i : i + _BLOCK] for i in range(0, len(codes), _BLOCK)]
    if known is None:
        known = bounds(codes, [entry], costs, _BLOCK) if len(blocks) > 1 else [(), costs]
    letters, state = [], entry
    for block, after in zip(blocks, known[1:]):
        text, state = _follow(block, state, after)
        letters.append(text)
    return "".join(letters), state


@lru_cache(maxsize=1 << 16)
def _follow(block: bytes, entry: int, costs: tuple[int, ...]) -> tuple[str, int]:
    arcs, price, tight, end = _prices([_LAYERS[c] for c in block], [entry], costs)
    node, letters = entry, []
    while node < end - 4:
        _, letter, node = min((a for a in arcs[node] if tight[a[2]] and price[node] == a[0] + price[a[2]]), key=lambda a: a[1])
        letters.append(letter)
    return "".join(letters), node % 4


@lru_cache(maxsize=1 << 16)
def repair(codes: bytes) -> tuple[int, str]:
    """(cost, letters) of the least of the cheapest edits of a whole conversation."""
    whole = codes + bytes([END])
    cost = next(a[0] for a in crossing(whole)[START] if a[3] == START)
    return cost, trace(whole, START, (0, FAR, FAR, FAR))[0]


def states_after(letters: str, initials, state: int = START):
    """The state after each letter; ``initials`` gives those of kept and dropped rows in order."""
    for letter in letters:
        if letter == "I":
            state = _NEXT[state]
        else:
            initial = next(initials)
            if letter == "K":
                state = SYSTEM if initial == "s" else _NEXT[state]
            elif letter == "R":
                state = _NEXT[state]
        yield state
