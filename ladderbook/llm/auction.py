"""Cheapest edits of a run of messages, by the auction algorithm for shortest paths.

Nodes are (message, state): how many messages are decided, and what the repaired roles end in: nothing,
a system, a user or an assistant message. Arcs decide a message or insert one. A path is extended by
its best arc or, where the end's price can rise, contracted; when it reaches the goal the prices are
dual values in which every arc of every cheapest path is tight.
"""

from __future__ import annotations

START, SYSTEM, USER, ASSISTANT = range(4)
#: state after a message by the turns' rule, for inserted and re-roled ones
NEXT = (USER, USER, ASSISTANT, USER)
#: fixed values: costs of the edits
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CLEAN, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua?"  # ? for all others
ENDS_IN = ("", "s", "u", "a")
FAR = 1 << 40


def parts(letter: str) -> tuple[str, int]:
    """A letter's initial and fault: a-d are system messages by fault, e-h users', i-l assistants', m-p all others."""
    n = ord(letter) - ord("a")
    return INITIALS[n // 4], n % 4


def _arcs(letter: str) -> list[list[tuple[int, int, str]]]:
    """(cost, next state, edit) of each state's arcs over a message, edits in order of their letters."""
    initial, fault = parts(letter)
    out = []
    for state in range(4):
        arcs = [(DELETE, state, "D")]
        if fault in (CLEAN, CUT):
            more = TRUNCATED if fault == CUT else 0
            own = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(initial)
            if own is not None:
                arcs.append((more, own, "K"))
            arcs.append((more + RE_ROLE, NEXT[state], "R"))
        out.append(arcs)
    return out


ARCS = {letter: _arcs(letter) for letter in "abcdefghijklmnop"}


class Lattice:
    """Messages by their letters, then a goal that a state of the last layer reaches at its cost in `ends`.

    With `closing`, messages may be inserted behind the last one too. The first prices are 2 for every
    faulty message to come, which no path can do without, so prices have little left to rise.
    """

    def __init__(self, letters: str, ends: tuple[int, ...], closing: bool):
        self.n, self.ends = len(letters), ends
        self.rows = [ARCS[x] for x in letters]
        self.inserts = self.n + closing  # layers that have them
        due = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            due[i] = due[i + 1] + (DELETE if (ord(letters[i]) - 97) % 4 else 0)
        low = min(ends)
        # once users or assistants speak, they go on to: without a goal among them, their nodes lead nowhere
        stuck = ends[USER] >= FAR and ends[ASSISTANT] >= FAR
        self.price = [FAR if stuck and q >= USER else d + low for d in due for q in range(4)]
        self.dead: set[int] = set()

    def _out(self, node: int) -> list[tuple[int, int, str]]:
        """(cost, node or -1 for the goal, edit), by edit."""
        layer, state = divmod(node, 4)
        if layer == self.n:
            found = [(self.ends[state], -1, "")] if self.ends[state] < FAR else []
            return found + [(INSERT, 4 * layer + NEXT[state], "I")] if layer < self.inserts else found
        base = 4 * layer + 4
        found = [(c, base + s, e) for c, s, e in self.rows[layer][state]]
        if layer < self.inserts:
            found.insert(1, (INSERT, 4 * layer + NEXT[state], "I"))
        return found

    def settle(self, state: int) -> int:
        """The cost of the cheapest path from (0, state); its arcs are tight in the prices after that. FAR if there is none."""
        price, path = self.price, [state]
        while path:
            node = path[-1]
            best, to = FAR, None
            for cost, j, _ in self._out(node):
                value = cost + (price[j] if j >= 0 else 0)
                if value < best:
                    best, to = value, j
            if to is None or best >= FAR:
                price[node] = FAR
                path.pop()
            elif price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                return price[state]
            else:
                path.append(to)
        return FAR

    def least(self, state: int) -> tuple[str, int]:
        """After settle(state): the edits of the cheapest path that are least as a text, and the last layer's state.

        Tight arcs are followed in order of their edits; where they lead nowhere, back.
        """
        path, edits, untried = [state], [], [self._tight(state)]
        while True:
            node = path[-1]
            edit, to = next(untried[-1], (None, None))
            if edit is None:
                self.dead.add(node)
                path.pop()
                untried.pop()
                edits.pop()
            elif to < 0:
                return "".join(edits), node % 4
            elif to not in self.dead:
                path.append(to)
                edits.append(edit)
                untried.append(self._tight(to))

    def _tight(self, node: int):
        price = self.price
        return iter([(e, j) for c, j, e in self._out(node) if price[node] == c + (price[j] if j >= 0 else 0)])


#: what the states cost where a conversation ends
END = (0, FAR, FAR, 0)


def solved(letters: str) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    lattice = Lattice(letters, END, True)
    cost = lattice.settle(START)
    return cost, lattice.least(START)[0]


def costs(letters: str, closing: bool) -> list[list[int]]:
    """The least cost from each first to each last state of a run; with closing, to the conversation's end (one column)."""
    goals = [END] if closing else [tuple(0 if q == goal else FAR for q in range(4)) for goal in range(4)]
    lattices = [Lattice(letters, ends, closing) for ends in goals]
    return [[x.settle(q) for x in lattices] for q in range(4)]


def traced(letters: str, ends: tuple[int, ...], closing: bool) -> list[tuple[int, str, int]]:
    """(cost to the conversation's end, edits, last state) from each first state, where the last states cost `ends` from there on."""
    lattice, found = Lattice(letters, ends, closing), []
    for q in range(4):
        cost = lattice.settle(q)
        lattice.dead.clear()
        found.append((cost, *lattice.least(q)) if cost < FAR else (FAR, "", q))
    return found


def decided(edits: str, letters: str, state: int) -> tuple[list[str], int]:
    """What becomes of each message, and the state after them: initials of the roles inserted before it, a dot and k
    (kept) or the initial of its new role, as in '.k', 'u.a' or '' (deleted). What is inserted behind the last
    message comes as one more, such as '+a'."""
    out, own, at = [], "", 0
    for e in edits:
        if e == "I":
            state = NEXT[state]
            own += ENDS_IN[state]
            continue
        if e == "K":
            initial = parts(letters[at])[0]
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
            own += ".k"
        elif e == "R":
            state = NEXT[state]
            own += "." + ENDS_IN[state]
        out.append(own)
        own = ""
        at += 1
    if own:
        out.append("+" + own)
    return out, state
