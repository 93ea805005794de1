"""Operator 4: secrets by fixed patterns and by formats inferred from labelled credentials.

The patterns label credentials in every document. For each kind a prefix tree of a bounded number
of the labelled strings is generalised by state merging: two states are merged when a Hoeffding
test finds no difference in how often strings end, in how they go on, and in how long they
still are, there and in all states below. States with too little support to be tested are pooled with
the others that follow the same state, and the pool is tested in their place; where it has too little
support itself, it is merged only with a state that has seen all that it does, lengths included. The
probabilistic automata then score every candidate run of the corpus, and its parts between
separators, against a character model of ordinary runs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from hashlib import sha256
from itertools import accumulate
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshloom.llm.common import Cache, Scratch, each_text, id_text, release_memos

# The kinds in order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs that are long enough
LEAST_VALUE, LEAST_ACCESS = 12, 18
SHORTEST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
ALPHABET = 68  # the characters a candidate may have
SEPARATORS = "=/.+-_"  # in the order in which a candidate is split


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def labelled(text: str, held: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(kind, credential) as the fixed patterns, whose spans are ``held``, label them; for assignments the value alone."""
    out = [(0, ASSIGN.match(text, a)[2]) for a, k, _ in held if k == 0]
    return out + [(k, text[a:b]) for a, k, b in held if k]


def ordinary_runs(text: str, held: list[tuple[int, int, int]]):
    """The candidate runs that overlap none of the fixed patterns' spans."""
    k = end = 0
    for m in CANDIDATE.finditer(text):
        a, z = m.span()
        while k < len(held) and held[k][0] < z:  # spans and runs both come in order
            end = max(end, held[k][2])
            k += 1
        if end <= a:
            yield m[0]


class State:
    __slots__ = ("n", "ends", "count", "to", "left")

    def __init__(self):
        self.n = self.ends = 0
        self.count: Counter = Counter()
        self.to: dict[str, State] = {}
        self.left: Counter = Counter()  # strings by how many characters they still have


def prefix_tree(strings) -> State:
    root = State()
    for s in strings:
        at = root
        for k, c in enumerate(s):
            at.n += 1
            at.left[len(s) - k] += 1
            at.count[c] += 1
            if (nxt := at.to.get(c)) is None:
                nxt = at.to[c] = State()
            at = nxt
        at.n += 1
        at.left[0] += 1
        at.ends += 1
    return root


LEAST = 30  # strings in a state that is tested; two such states differ from half of the strings on
SOME = 8  # strings, of which none ended in a state, that make it no end


def _differ(x: Counter, nx: int, y: Counter, ny: int, room: float) -> bool:
    return any(abs(x[k] / nx - y[k] / ny) > room for k in x.keys() | y.keys())


def _groups(count: Counter) -> Counter:
    out: Counter = Counter()
    for c, n in count.items():
        out[GROUP.get(c, c)] += n
    return out


def compatible(a: State, b: State, bound: float) -> bool:
    """No Hoeffding difference between two states, nor between those they lead to: in how many
    strings end, have each next character or one of each group, and each length still to go."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a is b or a.n < LEAST or b.n < LEAST:
            continue  # too few strings to tell them apart
        room = bound * (1 / math.sqrt(a.n) + 1 / math.sqrt(b.n))
        if abs(a.ends / a.n - b.ends / b.n) > room or _differ(a.count, a.n, b.count, b.n, room) or _differ(_groups(a.count), a.n, _groups(b.count), b.n, room) or _differ(a.left, a.n, b.left, b.n, room):
            return False
        todo += [(a.to[c], b.to[c]) for c in a.to.keys() & b.to.keys()]
    return True


def covers(a: State, b: State) -> bool:
    """Whether all that the few strings of ``b`` do was seen in ``a``, a state with support: the lengths
    to go and the groups of next characters, there and below."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a.n >= LEAST and not (b.left.keys() <= a.left.keys() and _groups(b.count).keys() <= _groups(a.count).keys()):
            return False
        todo += [(a.to[c], b.to[c]) for c in a.to.keys() & b.to.keys()]
    return True


def fold(red: State, blue: State) -> list[State]:
    """Add the tree below ``blue`` to the automaton at ``red``; the states that got more strings."""
    todo, changed = [(red, blue)], []
    while todo:
        r, b = todo.pop()
        changed.append(r)
        r.n += b.n
        r.ends += b.ends
        r.count.update(b.count)
        r.left.update(b.left)
        for c, nxt in b.to.items():
            if c in r.to:
                todo.append((r.to[c], nxt))
            else:
                r.to[c] = nxt
    return changed


# Characters that formats take or leave together.
GROUP = {c: k for k, some in enumerate(("ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "abcdef", "ghijklmnopqrstuvwxyz", "0123456789", "+/_.=-")) for c in some}

# The characters of a candidate by class: one that wasn't seen in a state, where its class was, is possible there.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_.=-")


def _probabilities(state: State, number: dict[int, int]) -> tuple[dict[str, tuple[int, float]], float]:
    """char -> (next state, log p), and log p of the end. As many characters of a class as were seen
    stand for those that weren't (Witten and Bell); they lead where most of their class go. Where
    letters of either case and digits were seen, one string stands for the rest. A state with enough
    support in which no string ended is no end."""
    seen = [(k, [c for c in k if c in state.to]) for k in CLASSES]
    seen = [(k, have) for k, have in seen if have]
    ends = state.ends or (0 if state.n >= SOME else 0.1)
    rest = CLASSES[3] if [k for k, _ in seen] == [*CLASSES[:3]] else ""
    total = state.n - state.ends + ends + sum(len(have) for k, have in seen if len(have) < len(k)) + bool(rest)
    out = {}
    for k, have in seen:
        most: Counter = Counter()
        for c in have:
            out[c] = number[id(state.to[c])], math.log(state.count[c] / total)
            most[number[id(state.to[c])]] += state.count[c]
        target = min(most, key=lambda x: (-most[x], x))
        out |= {c: (target, math.log(len(have) / (len(k) - len(have)) / total)) for c in k if c not in state.to}
    if rest:
        most = Counter()
        for c, n in state.count.items():
            most[number[id(state.to[c])]] += n
        out |= dict.fromkeys(rest, (min(most, key=lambda x: (-most[x], x)), math.log(1 / len(rest) / total)))
    return out, math.log(ends / total) if ends else -math.inf


def infer(strings: list[str], alpha: float = 0.05) -> list[tuple[dict[str, tuple[int, float]], float]]:
    """A probabilistic automaton: per state (char -> (next state, log p), log p of the end)."""
    root = prefix_tree(sorted(strings))
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, known, todo = [root], {id(root)}, [root]
    while todo:
        r = todo.pop(0)
        # Its successors that are still trees: the well supported one by one, then the others pooled.
        blue = sorted((c for c in r.to if id(r.to[c]) not in known), key=lambda c: (-r.to[c].n, c))
        if not blue:
            continue
        chars, b = blue[:1], r.to[blue[0]]
        if b.n < LEAST:
            chars = blue
            for c in blue[1:]:
                fold(b, r.to[c])
        todo.insert(0, r)
        same = next((x for x in red if x.n >= LEAST and (compatible(x, b, bound) if b.n >= LEAST else covers(x, b))), None)
        for c in chars:
            r.to[c] = b if same is None else same
        if same is None:
            red.append(b)
            known.add(id(b))
            todo.append(b)
        else:
            todo += [x for x in fold(same, b) if id(x) in known]
    number = {id(s): k for k, s in enumerate(red)}
    return [_probabilities(s, number) for s in red]


NOWHERE = (-1, 0.0)
SHOUTED = math.log(0.01)  # of a run in capitals


class Formats(NamedTuple):
    """Automata by kind; the log p of each character in ordinary runs; the least score.

    The ordinary model has no context: what unlabelled credentials the documents hold then hardly
    moves it, whereas after an odd character only they would tell what follows.
    """

    automata: dict[int, list]
    ordinary: dict[str, float]
    unseen: float
    least: float

    def score(self, s: str) -> float:
        """The best format's log likelihood ratio against ordinary runs, for each character; minus
        infinity for a run that no automaton accepts."""
        best = -math.inf
        for states in self.automata.values():
            at, total = 0, 0.0
            for c in s:
                at, p = states[at][0].get(c, NOWHERE)
                if at < 0:
                    break  # the run leaves the automaton: it isn't of this format
                total += p
            else:
                best = max(best, total + states[at][1])
        if best == -math.inf:
            return best
        get, unseen = self.ordinary.get, self.unseen
        plain = sum(get(c, unseen) for c in s)
        if s.isupper():  # words are also written in capitals
            plain = max(plain, sum(get(c, unseen) for c in s.lower()) + SHOUTED)
        return (best - plain) / len(s)


def fit_formats(docs: DataFrame, per_kind: int = 1_000, least: float = 1.0, fewest: int = 30, longest: int = 256) -> Formats:
    """Automata and the ordinary model from all documents.

    Every document is labelled. Of the different credentials of each kind that have at most
    ``longest`` characters ``per_kind`` (smallest checksum first) come to the driver; kinds that have
    fewer than ``fewest`` of them in all documents have no automaton. The ordinary model counts the characters
    of all other runs. A run is reported from ``least`` nats for each character on.
    """
    most = max(per_kind, fewest)

    def gather(batches):
        """(kind, checksum, credential), the least of a task; (3, count, character)."""
        kept: list[set] = [set(), set(), set()]
        chars: Counter = Counter()
        release_memos()

        def least_of(found: set) -> list:
            return sorted(found)[:most]

        for b in batches:
            for text in each_text(b.column(1)):
                held = base_spans(text)
                for kind, s in labelled(text, held):
                    if len(s) <= longest:
                        kept[kind].add((crc32(s.encode()), s))
                chars.update("".join(ordinary_runs(text, held)))
                for kind, found in enumerate(kept):
                    if len(found) > 8 * most:
                        kept[kind] = set(least_of(found))
        rows = [(k, c, s) for k, found in enumerate(kept) for c, s in least_of(found)] + [(3, n, c) for c, n in sorted(chars.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["kind", "crc", "s"])

    scratch = Scratch(docs.sparkSession, "formats")
    pool = scratch.put(id_text(docs).mapInArrow(gather, "kind int, crc long, s string"), "pool")
    # top-n of each kind, merged from the tasks' own top-n
    got = [[r[0] for r in pool.where(F.col("kind") == kind).select("crc", "s").distinct().orderBy("crc", "s").limit(most).select("s").collect()] for kind in range(3)]
    chars = {r[0]: r[1] for r in pool.where("kind = 3").groupBy("s").agg(F.sum("crc")).collect()}
    scratch.drop(pool)
    total = sum(chars.values()) + 0.1 * ALPHABET
    ordinary = {c: math.log((n + 0.1) / total) for c, n in chars.items()}
    formats = Formats({k: infer(some[:per_kind]) for k, some in enumerate(got) if len(some) >= fewest}, ordinary, math.log(0.1 / total), math.inf)
    if not formats.automata:
        return formats
    return formats._replace(least=least)


def _formatted(text: str, a: int, z: int, score, least: float):
    """What of a candidate run has an inferred format: the run, or else its parts between the first
    separator it has, or else theirs between the next one."""
    todo = [(a, z, 0)]
    while todo:
        a, z, level = todo.pop()
        if z - a < SHORTEST:
            continue
        run = text[a:z]
        if score(run) >= least:
            yield a, z
            continue
        while level < len(SEPARATORS) and SEPARATORS[level] not in run:
            level += 1
        if level < len(SEPARATORS):
            for part in run.split(SEPARATORS[level]):
                todo.append((a, a + len(part), level + 1))
                a += len(part) + 1


def all_spans(text: str, base: list[tuple[int, int, int]], score, least: float) -> list[tuple[int, int, int]]:
    if least == math.inf:
        return base
    more = [(a, 3, z) for m in CANDIDATE.finditer(text) for a, z in _formatted(text, *m.span(), score, least)]
    if more and base:
        starts, ends = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
        more = [s for s in more if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[0]]
    return sorted(base + more) if more else base


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def secret_spans(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """Secrets of every text: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    One row per input row, null counts as empty (no spans: empty string, and its digest). Spans
    count code points, ends excluded. Inferred spans have the kind ``format`` and never overlap a
    fixed one; they are whole candidate runs, or parts of them between separators. Other columns are not carried. Narrow apart from the fit.
    """
    formats = formats or fit_formats(docs)

    def run(batches):
        release_memos()
        score = Cache(formats.score, 50_000).__getitem__
        for b in batches:
            counts, digest, spans = ([], [], []), [], []
            for text in each_text(b.column(1)):
                base = base_spans(text)
                for k, to in enumerate(counts):
                    to.append(sum(s[1] == k for s in base))
                digest.append(sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans(text, base, score, formats.least)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", formats: Formats | None = None) -> DataFrame:
    """The documents with every secret's span replaced by ``mark``; overlapping spans become one.

    All columns come back; ``n_chars``, where there is such a column, counts the new text. A null
    text stays null.
    """
    formats = formats or fit_formats(docs)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None, score) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for a, _, z in all_spans(text, base_spans(text), score, formats.least):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, z)
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        release_memos()
        score = Cache(formats.score, 50_000).__getitem__
        for whole in batches:
            for start in range(0, whole.num_rows, 500):  # a few texts at a time, old and new
                b = whole.slice(start, 500)
                cols = list(b.columns)
                old = cols[at].to_pylist()
                new = [clean(t, score) for t in old]
                cols[at] = pa.array(new, pa.string())
                if chars is not None:
                    cols[chars] = pa.array([n if x == y else len(y) for n, x, y in zip(cols[chars].to_pylist(), old, new, strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([(f.name, c.type) for f, c in zip(b.schema, cols, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
