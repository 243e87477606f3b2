"""Operator 6: secrets by fixed patterns and by inferred grammars.

One scan of the texts finds the base matches and all candidates: runs of ``MIN`` or more credential characters that don't lie
within one base match. From the credentials that the base patterns label, kind by kind, and from ordinary candidates for contrast,
probabilistic automata are inferred by merging compatible states of a prefix tree. Its edges are classes of characters (digits, the
letters of hexadecimal numbers, other letters by case, each mark by itself); a state also counts the characters of each class, so
that fixed beginnings such as AKIA show. Two states are compatible if what both have seen, with all that follows alike, is likelier from one state than from
two (marginal likelihoods under Dirichlet priors, which hold for small counts too; the characters of a class may be drawn evenly). First states of one depth are merged, which leaves chains that know lengths; then a state
and its successor, which makes loops where lengths vary.

Each candidate is then scored by the likelihood of its format: bits in favour of the best credential automaton over the
ordinary one; what no format explains has no bits. Spans of ``LIKELY`` bits or more are added as kind ``grammar``; they may overlap base spans, which all stay.

Inference takes at most ``most`` distinct values a kind (those with the smallest hash), a parameter; scanning and scoring cover every text and every candidate.

Defined cases: null and empty texts have no span; texts may be of any length; without labelled credentials nothing is
added; repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Memo, arrow_map, documents, written

KINDS = ("assign", "access", "hex", "grammar")
MIN, MOST, LIKELY, SLACK = 12, 1_000, 24.0, 12.0
#: Weights of the priors over what follows a state, and over the characters of a class.
FOLLOW, WITHIN = 1 / 12, 8.0

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so a run of 16 or more is one that doesn't fail
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN)
_KEY = re.compile(r"(?ai:passw|secret|token|api_?key)")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, credential) of the matches that hold, in order."""
    out = []
    if _KEY.search(text):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list) -> list[tuple[int, int]]:
    """Runs of credential characters that don't lie within one base span."""
    out, k, reach = [], 0, -1
    base = sorted((a, b) for a, _, b, _ in base)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][0] <= a:  # the furthest end of what begins at or before the run
            reach, k = max(reach, base[k][1]), k + 1
        if reach < b:
            out.append((a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all base matches (kind 0 to 2) and candidates (kind 3) of every row."""

    def make():
        def step(doc_id, text):
            rows = []
            for t in text:
                t = t or ""
                base = base_spans(t)
                rows.append(
                    [{"kind": k, "start": a, "end": b, "value": v} for a, k, b, v in base]
                    + [{"kind": 3, "start": a, "end": b, "value": t[a:b]} for a, b in candidates(t, base)]
                )
            return {"doc_id": pa.array(doc_id, pa.int64()), "found": pa.array(rows, pa.list_(SPAN))}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, found array<struct<kind:int,start:int,end:int,value:string>>")


#: Classes of characters with their sizes; a mark is a class of its own.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in "+/_.=-"}
CLASS_OF = {c: k for k, cs in CLASSES.items() for c in cs}
OUTCOMES = len(CLASSES) + 1  # or the end


class State:
    """What was seen here: how often at all, how often the end, and by class how often, which characters, and what comes after."""

    __slots__ = ("n", "stop", "to", "chars", "depth")

    def __init__(self, depth: int):
        self.n, self.stop, self.depth = 0, 0, depth
        self.to: dict[str, State] = {}
        self.chars: dict[str, Counter] = {}


def prefix_tree(strings: list[str]) -> State:
    root = State(0)
    for s in strings:
        at = root
        at.n += 1
        for c in s:
            k = CLASS_OF[c]
            at.chars.setdefault(k, Counter())[c] += 1
            at = at.to.get(k) or at.to.setdefault(k, State(at.depth + 1))
            at.n += 1
        at.stop += 1
    return root


def evidence(counts: list[int], weight: float, outcomes: int) -> float:
    """The log marginal likelihood of counts under a symmetric Dirichlet prior."""
    total = weight * outcomes
    return math.lgamma(total) - math.lgamma(total + sum(counts)) + sum(math.lgamma(c + weight) - math.lgamma(weight) for c in counts if c)


def even_share(seen: Counter, k: str) -> tuple[float, float]:
    """Of a class's characters: the log evidence, where they are drawn evenly or else with weights of their own, one as likely as the
    other beforehand; and how likely the former is now."""
    size, n = len(CLASSES[k]), sum(seen.values())
    even, own = -n * math.log(size), evidence(list(seen.values()), WITHIN / size, size)
    top = max(even, own)
    total = top + math.log(0.5 * math.exp(even - top) + 0.5 * math.exp(own - top))
    return total, 0.5 * math.exp(even - total)


def own_evidence(states: list[State]) -> float:
    """That of what states have seen, taken as one."""
    follow, chars = Counter(), {}
    for s in states:
        follow[""] += s.stop
        for k, seen in s.chars.items():
            follow[k] += sum(seen.values())
            chars.setdefault(k, Counter()).update(seen)
    return evidence(list(follow.values()), FOLLOW, OUTCOMES) + sum(even_share(c, k)[0] for k, c in chars.items() if len(CLASSES[k]) > 1)


def compatible(a: State, b: State) -> float:
    """The log of how much likelier the tree at ``b`` is from the state ``a``, over all that both have seen more than once."""
    total, todo = 0.0, [(a, b)]
    while todo:
        a, b = todo.pop()
        total += own_evidence([a, b]) - own_evidence([a]) - own_evidence([b])
        todo += [(a.to[k], b.to[k]) for k in a.to.keys() & b.to.keys() if a.to[k].n > 1 and b.to[k].n > 1]
    return total


def fold_into(a: State, b: State) -> None:
    """Adds the tree at ``b`` to the state ``a``."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        a.n, a.stop = a.n + b.n, a.stop + b.stop
        for k, seen in b.chars.items():
            a.chars.setdefault(k, Counter()).update(seen)
        for k, child in b.to.items():
            if k in a.to:
                todo.append((a.to[k], child))
            else:
                a.to[k] = child


def layered(strings: list[str]) -> list[State]:
    """The states after merging those of one depth, layer by layer."""
    states = layer = [prefix_tree(strings)]
    while layer:
        below: list[State] = []
        children = sorted({id(c): c for s in layer for c in s.to.values()}.values(), key=lambda c: -c.n)
        into: dict[int, State] = {}
        for child in children:
            best = max(((compatible(s, child), -k) for k, s in enumerate(below)), default=(0.0, 0))
            if best[0] > 0:
                fold_into(below[-best[1]], child)
                into[id(child)] = below[-best[1]]
            else:
                below.append(child)
                into[id(child)] = child
        for s in layer:
            s.to = {k: into[id(c)] for k, c in s.to.items()}
        states = states + below
        layer = below
    return states


def looped(states: list[State]) -> list[list[State]]:
    """Blocks of states after merging states with their successors, with all that this makes one, where that is likelier."""
    number = {id(s): i for i, s in enumerate(states)}
    block = list(range(len(states)))  # of each state; blocks are named by their first state

    def members(of: list[int]) -> dict[int, list[State]]:
        out: dict[int, list[State]] = {}
        for i, b in enumerate(of):
            out.setdefault(b, []).append(states[i])
        return out

    value = {i: own_evidence([s]) for i, s in enumerate(states)}
    for i, s in enumerate(states):
        for k in sorted(s.to):
            a, b = block[i], block[number[id(s.to[k])]]
            if a == b:
                continue
            trial, todo = list(block), [(a, b)]
            while todo:  # what follows merged states by one class is merged too
                x, y = todo.pop()
                x, y = trial[x], trial[y]
                if x == y:
                    continue
                x, y = min(x, y), max(x, y)
                trial = [x if t == y else t for t in trial]
                follow: dict[str, int] = {}
                for j, t in enumerate(trial):
                    if t == x:
                        for c, child in states[j].to.items():
                            z = number[id(child)]
                            todo.append((follow.setdefault(c, z), z))
            old, new = members(block), members(trial)
            changed = [b for b in new if len(new[b]) != len(old.get(b, ()))]
            fresh = {b: own_evidence(new[b]) for b in changed}
            gone = {block[j] for b in changed for j in range(len(states)) if trial[j] == b}
            if sum(fresh.values()) > sum(value[g] for g in gone):
                block = trial
                value = {b: fresh.get(b, value.get(b, 0.0)) for b in new}
    return list(members(block).values())


def infer(strings: list[str], least: int = 1) -> list[tuple[float, dict[str, tuple[float, int]]]]:
    """A probabilistic automaton: per state the bits of the end, and per character bits and next state. Ways that fewer than ``least``
    strings took count as not seen."""
    blocks = looped(layered(sorted(strings)))
    number = {id(s): i for i, block in enumerate(blocks) for s in block}
    out = []
    for i, block in enumerate(blocks):
        n, stop = sum(s.n for s in block), sum(s.stop for s in block)
        bits = lambda times: math.log2((times + FOLLOW) / (n + FOLLOW * OUTCOMES))  # noqa: B023, E731
        table = {}
        for k, members in CLASSES.items():
            seen = Counter()
            for s in block:
                seen.update(s.chars.get(k, ()))
            if sum(seen.values()) < least:
                seen.clear()
            times, after = sum(seen.values()), next((number[id(s.to[k])] for s in block if k in s.to and seen), i)
            even = even_share(seen, k)[1] / len(members)
            for c in members:
                table[c] = (bits(times) + math.log2(even + (1 - even * len(members)) * (seen[c] + WITHIN / len(members)) / (times + WITHIN)), after)
        out.append((bits(stop), table))
    return out


def bits_of(automaton, s: str) -> float:
    """log2 probability of a string; a class that a state hasn't seen keeps the state."""
    at, total = 0, 0.0
    for c in s:
        bits, at = automaton[at][1][c]
        total += bits
    return total + automaton[at][0]


def grammars(found: DataFrame, most: int = MOST) -> tuple[list, list]:
    """Automata of the credential kinds, and that of ordinary candidates, from at most ``most`` values a kind."""
    values = found.select(F.explode("found").alias("f")).select("f.kind", "f.value").distinct()
    # up to a thousand rows a kind, Spark cuts each partition before the shuffle
    first = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    sample: dict[int, list[str]] = {}
    for row in values.withColumn("place", first).where(F.col("place") <= most).toLocalIterator():  # at most ``most`` rows a kind
        if set(row["value"]) <= CLASS_OF.keys():
            sample.setdefault(row["kind"], []).append(row["value"])
    ordinary = sample.pop(3, [])
    return [infer(v) for _, v in sorted(sample.items())], infer(ordinary, 2) if ordinary else None  # one run alone isn't ordinary


def format_bits(value: str, credential: list, ordinary) -> float:
    """Bits in favour of the likeliest credential format, against ordinary runs. A value that no format explains about as well as
    characters drawn evenly would be (``SLACK``) has none."""
    even = -math.log2(len(CLASS_OF) + 1) * (len(value) + 1)
    best = max((bits_of(a, value) for a in credential), default=float("-inf"))
    if best < even - SLACK:
        return float("-inf")
    return best - (bits_of(ordinary, value) if ordinary else even)


def secrets(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_grammar, base_sha256, spans of every row of ``docs`` (doc_id, text)."""
    found = written(scan(docs), "secrets")
    shared = docs.sparkSession.sparkContext.broadcast(grammars(found, most))

    def make():
        bits = Memo(lambda v: format_bits(v, *shared.value))

        def step(doc_id, found):
            counts, base, spans = [], [], []
            for f in found:
                fixed = [(x["start"], x["kind"], x["end"]) for x in f if x["kind"] < 3]
                added = [(x["start"], 3, x["end"]) for x in f if x["kind"] == 3 and bits[x["value"]] >= LIKELY]
                counts.append([sum(k == j for _, k, _ in fixed) for j in range(3)] + [len(added)])
                base.append(hashlib.sha256(joined(fixed).encode()).hexdigest())
                spans.append(joined(fixed + added))
            out = {"doc_id": pa.array(doc_id, pa.int64())}
            out |= {f"n_{k}": pa.array([c[j] for c in counts], pa.int64()) for j, k in enumerate(KINDS)}
            return out | {"base_sha256": pa.array(base, pa.string()), "spans": pa.array(spans, pa.string())}

        return step

    return arrow_map(found, make, "doc_id long, n_assign long, n_access long, n_hex long, n_grammar long, base_sha256 string, spans string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
