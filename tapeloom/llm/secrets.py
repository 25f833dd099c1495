"""Secret scans with one deterministic automaton for all rules.

A rule is a head and a body: the head's regular expression, then as many characters of
one class as there are.  Heads, each with the first few body characters, are compiled
together: to an automaton of Thompson's kind with an unanchored start, by subset
construction over classes of bytes, and to the fewest states by refining partitions.
Its transition rows are plain lists that hold each other, so that one step a byte runs
all rules.  Where a rule accepts, the automaton of its reversed expression walks back to
the leftmost start and the body is followed to its end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches, small_batches, texts_of


@dataclass(frozen=True)
class Rule:
    """``head`` then a run of ``body`` bytes; a run of fewer than ``least`` is dropped, but hides what begins in it.

    The automaton reports a match from ``early`` body bytes on (at most ``least``); a
    larger number means fewer reports, and is right where a match of fewer bytes
    than that can hide nothing.
    """

    kind: str
    head: str
    body: str
    least: int
    early: int = 1


#: The base rules.  Access and hex matches may be reported late: what begins in a short one ends with it and is shorter still.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6),
    Rule("access", r"AKIA", r"[A-Z0-9]", 16, 4),
    Rule("hex", r"", r"[0-9a-f]", 24, 8),
)
#: Public formats of keys and tokens, besides the base rules.
MORE = (
    Rule("github", r"gh[opsur]_", r"[A-Za-z0-9]", 36, 4),
    Rule("slack", r"xox[abeoprs]-", r"[A-Za-z0-9-]", 10, 4),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]", 35, 4),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]", 16),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY", r"-", 5),
    Rule("stripe", r"[rs]k_live_", r"[A-Za-z0-9]", 16, 4),
)
RULES = BASE + MORE


class _Nfa:
    """States with byte-set and empty transitions."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int, either_case: bool, backwards: bool) -> int:
        """Append the parsed expression after state ``at``; its last state."""
        for op, arg in reversed(list(tree)) if backwards else tree:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                new = self.state()
                self.moves[at].append((_bytes_of(name, arg, either_case), new))
                at = new
            elif name == "SUBPATTERN":
                _, on, off, inner = arg
                at = self.add(inner, at, (either_case or bool(on & sre.SRE_FLAG_IGNORECASE)) and not off & sre.SRE_FLAG_IGNORECASE, backwards)
            elif name == "BRANCH":
                end = self.state()
                for option in arg[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.add(option, begin, either_case, backwards)].append(end)
                at = end
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, either_case, backwards)
                if high is sre.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.empty[at] += [loop, end]
                    self.empty[self.add(inner, loop, either_case, backwards)] += [loop, end]
                    at = end
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(inner, at, either_case, backwards)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"{name} has no automaton here")
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes_of(name: str, arg, either_case: bool) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(256)) - {10}
    out: set[int] = set()
    turned = name == "NOT_LITERAL"
    for op, x in [("LITERAL", arg)] if name != "IN" else arg:
        if str(op) == "NEGATE":
            turned = True
        elif str(op) == "LITERAL":
            out.add(x)
        elif str(op) == "RANGE":
            out |= set(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"{op} has no set of bytes here")
    if max(out, default=0) > 127:
        raise ValueError("rules are made of ASCII characters")
    if either_case:
        out |= {b ^ 32 for b in out if chr(b).isalpha()}
    return frozenset(range(256)) - out if turned else frozenset(out)


@dataclass
class Dfa:
    """``table[state, class]``, ``classes[byte]``, and the rules that each state accepts; state 0 begins."""

    table: np.ndarray
    classes: np.ndarray
    accepts: list[tuple[int, ...]]


def compile_rules(patterns: list[str], unanchored: bool, backwards: bool = False) -> Dfa:
    """The smallest deterministic automaton that tells which of the patterns end at a byte."""
    nfa = _Nfa()
    begin = nfa.state()
    ends: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.empty[begin].append(first)
        ends[nfa.add(sre.parse(pattern), first, False, backwards)] = k
    sets = {s for moves in nfa.moves for s, _ in moves}
    marks = [tuple(b in s for s in sorted(sets, key=sorted)) for b in range(256)]
    numbers: dict[tuple, int] = {}
    classes = np.array([numbers.setdefault(m, len(numbers)) for m in marks])
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(len(numbers))]
    start = nfa.closure([begin])
    found, todo, table = {start: 0}, [start], []
    for now in todo:  # grows
        row = []
        for byte in example:
            after = {t for s in now for on, t in nfa.moves[s] if byte in on}
            after = nfa.closure(after | {begin} if unanchored else after)
            if after not in found:
                found[after] = len(todo)
                todo.append(after)
            row.append(found[after])
        table.append(row)
    return _minimised(Dfa(np.array(table), classes, [tuple(sorted(ends[s] for s in x if s in ends)) for x in todo]))


def _minimised(dfa: Dfa) -> Dfa:
    """States are first parted by what they accept, then by the parts that they move to, until no part splits."""
    names: dict[tuple, int] = {}
    part = np.array([names.setdefault(a, len(names)) for a in dfa.accepts])
    while True:
        _, new = np.unique(np.concatenate([part[:, None], part[dfa.table]], 1), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == part.max():
            break
        part = new
    order = np.argsort(np.unique(part, return_index=True)[1])  # the first state's part is 0
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    part = place[part]
    first = np.unique(part, return_index=True)[1]
    return Dfa(part[dfa.table[first]], dfa.classes, [dfa.accepts[i] for i in first])


class _Accept:
    """Stands for an accepting state's row; a step from it raises TypeError, which is how the loop learns of a match."""

    __slots__ = ("row", "rules")

    def __init__(self, row, rules):
        self.row, self.rules = row, rules


@dataclass
class Automata:
    """The automaton of all rules, and the reversed one of each rule; compiled once and sent to the tasks as arrays."""

    rules: tuple[Rule, ...]
    forward: Dfa
    backward: list[Dfa]


def automata(rules: tuple[Rule, ...] = RULES) -> Automata:
    heads = [f"(?:{r.head}){r.body}{{{r.early}}}" for r in rules]
    return Automata(rules, compile_rules(heads, unanchored=True), [compile_rules([h], unanchored=False, backwards=True) for h in heads])


class Scanner:
    """All rules in one pass over the bytes of a text."""

    def __init__(self, compiled: Automata):
        self.rules = compiled.rules
        dfa = compiled.forward
        rows: list[list] = [[] for _ in dfa.table]
        shown = [_Accept(r, a) if a else r for r, a in zip(rows, dfa.accepts)]
        for row, targets in zip(rows, dfa.table[:, dfa.classes].tolist()):
            row += [shown[t] for t in targets]
        self.start = rows[0]
        self.back = [(d.table[:, d.classes].tolist(), [bool(a) for a in d.accepts], [bool((row == k).all()) for k, row in enumerate(d.table)]) for d in compiled.backward]
        self.body = [bytes(sorted(_bytes_of("IN", op[1], False) if str(op[0]) == "IN" else {op[1]})) for op in (sre.parse(r.body)[0] for r in self.rules)]

    def _leftmost(self, data: bytes, k: int, end: int, after: int) -> int:
        """The first start, not before ``after``, of a match of rule k that ends at ``end``; -1 if there is none."""
        table, accepts, ended = self.back[k]
        state, best = 0, -1
        for i in range(end - 1, after - 1, -1):
            state = table[state][data[i]]
            if accepts[state]:
                best = i
            elif ended[state]:
                break
        return best

    def spans(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule; leftmost, non-overlapping for each rule."""
        if not text:
            return []
        out = []
        over = [0] * len(self.rules)  # where the last match of each rule ends
        data = text + b"\n"  # a byte after the text shows an accepting last state
        left = iter(data)
        row = self.start
        while True:
            try:
                for c in left:
                    row = row[c]
                break
            except TypeError:
                at = len(data) - left.__length_hint__() - 1  # the byte that could not be read
                for k in row.rules:
                    if at <= over[k]:
                        continue
                    start = self._leftmost(data, k, at, over[k])
                    if start < 0:
                        continue
                    # what is left of a run after its own characters are stripped, in steps so that a run costs its length
                    end, body = at, self.body[k]
                    while (piece := data[end : end + 4096]) and not (rest := piece.lstrip(body)):
                        end += len(piece)
                    end += len(piece) - len(rest) if piece else 0
                    over[k] = end
                    if end - (at - self.rules[k].early) >= self.rules[k].least:
                        out.append((start, end, k))
                row = row.row[data[at]]
        return sorted(out, key=lambda s: (s[0], s[2]))


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points."""
    if not spans or text.isascii():
        return spans
    places = sorted({p for s in spans for p in s[:2]})
    points, count, done = {}, 0, 0
    for p in places:
        count += len(text[done:p].decode())
        points[p] = count
        done = p
    return [(points[a], points[b], k) for a, b, k in spans]


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document ``doc_id``, ``found`` (kind, start, end in code points; by start, then the rules' order) and ``spans`` (kind:start:end, joined by commas).

    Matches of a rule are leftmost and do not overlap; those of different rules may.
    Null and empty texts have none.  One row per input row, repeated ids included; only
    the text is read, nothing is shuffled, and a text of any length costs one step a byte.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("spans", T.StringType())])

    shared = docs.sparkSession.sparkContext.broadcast(automata(rules))

    def run(parts):
        scanner = Scanner(shared.value)
        for b in batches(parts):
            found = [_points(t or b"", scanner.spans(t)) for t in texts_of(b.column("text"))]
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), pa.array([_joined(f, rules) for f in found], pa.string())], names=["doc_id", "found", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{kind}]") -> DataFrame:
    """The documents in their columns, with every span in ``text`` replaced by ``mark``; overlapping spans become one, named by the first."""
    small_batches(docs.sparkSession)

    shared = docs.sparkSession.sparkContext.broadcast(automata(rules))

    def run(parts):
        scanner = Scanner(shared.value)
        for b in batches(parts):
            at = b.schema.get_field_index("text")
            texts = []
            for t in texts_of(b.column(at)):
                out, done = [], 0
                for start, end, k in scanner.spans(t):
                    if start >= done:
                        out += [t[done:start], mark.format(kind=rules[k].kind).encode()]
                    done = max(done, end)
                texts.append(None if t is None else b"".join([*out, t[done:]]).decode())
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts of the contract from :func:`scan`."""
    from pyspark.sql import functions as F

    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))
    text = F.array_join(F.transform(base, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(text, 256).alias("base_sha256"), "spans")


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
