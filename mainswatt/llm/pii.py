"""Personal data by a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy on labelled spans: windows of a bounded sample of the corpus, labelled by the
base patterns, together with made-up strings of each kind. Those are written side by side (which a pattern that
takes the longest match reads as one and drops), and in ways that the patterns do not know: addresses with the at
sign or the points spelled out, phone numbers without a plus, cards cut by points, bracketed points in IP addresses;
dates, amounts, versions, rows of numbers, book and order numbers and plain numbers stand among them unlabelled. Tags are begin and inside of the four
kinds, and outside.

Windows of ``WINDOW`` characters, half overlapping, are laid over every digit, at sign or spelled-out at and its
surroundings, wherever in the text; a window without one can hold no span. The network scores each window; where
windows overlap, scores are averaged by how central the character stands, and one Viterbi pass decodes each maximal
stretch of windows whole (one of over ``PIECE`` characters in pieces that overlap and meet in the middle of the
overlap, so memory stays bounded). Decoded spans are added where, written the usual way, they pass their kind's
check (Luhn, byte range, digit count) and touch no base span; base spans stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .spans import PERSONAL, digest, holds, joined, luhn, personal

WINDOW, STRIDE, MARGIN = 64, 32, 24
SAMPLE = 512
TAGS = 1 + 2 * len(PERSONAL)
_CLASSES = "@.-+()% _,:\n\"'=atdo[]{}"
CLASSES = len(_CLASSES) + 6
_trigger = re.compile(r"[0-9@]|[(\[{] ?[Aa][Tt] ?[)\]}]| (?:at|AT) (?=[^\n]{1,40} (?:dot|DOT) )")
_at = re.compile(r" ?[(\[{] ?at ?[)\]}] ?| at ", re.IGNORECASE)
_dot = re.compile(r" ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot ", re.IGNORECASE)
_email_shape = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_ip_shape = re.compile(r"[0-9]+(\.[0-9]+){3}")
_card_shape = re.compile(r"[0-9]+([ .-]?[0-9])+")
_phone_shape = re.compile(r"\+?\(?[0-9]+\)?([ ./-]{0,2}\(?[0-9]+\)?)+")
_date = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
PIECE, OVERLAP = 1 << 16, 4 * 64
"""Characters decoded in one pass, and those that two passes share."""


def plausible(kind: str, s: str) -> bool:
    """Whether a string that the network found is of its kind, once spelled-out signs are written the usual way."""
    if kind == "email":
        return bool(_email_shape.fullmatch(_dot.sub(".", _at.sub("@", s))))
    if kind == "ip":
        plain = _dot.sub(".", s)
        return bool(_ip_shape.fullmatch(plain)) and holds("ip", plain)
    if kind == "card":
        return bool(_card_shape.fullmatch(s)) and holds("card", s)
    return bool(_phone_shape.fullmatch(s)) and holds("phone", s) and (s[0] == "+" or _national(s)) and not _date.search(s) and not _ip_shape.fullmatch(s)


def _national(s: str) -> bool:
    """Three groups or more, the last of four digits at least, or, after a leading 0, all of two at least."""
    sizes = [len(x) for x in re.findall("[0-9]+", s)]
    return len(sizes) > 2 and (sizes[-1] >= 4 or (s.lstrip("(")[0] == "0" and min(sizes) > 1))


def _class_table() -> np.ndarray:
    table = np.full(128, CLASSES - 1, np.uint8)
    table[48:58], table[65:91], table[97:123] = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2
    for i, c in enumerate(_CLASSES):
        table[ord(c)] = table[ord(c.upper())] = i
    return table


_TABLE = _class_table()
_PAD = len(_CLASSES) + 4


def encode(text: str) -> np.ndarray:
    """Character classes: digits, the letters of at and dot in either case, other letters by case, single signs, other scripts, the rest."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], len(_CLASSES) + 3).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights of both LSTM directions, the emission layer and the CRF."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"out": draw(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.w |= {f"in_{d}": draw(CLASSES, 4 * hidden) * 2, f"re_{d}": draw(hidden, 4 * hidden), f"b_{d}": np.zeros(4 * hidden, np.float32)}
            self.w[f"b_{d}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction over windows ``x`` (batch by length), in reading order of that direction."""
        n, length = x.shape
        h = c = np.zeros((n, self.hidden), np.float32)
        out, tape, k = np.empty((length, n, self.hidden), np.float32), [], self.hidden
        for t in range(length):
            z = self.w[f"in_{d}"][x[:, t]] + h @ self.w[f"re_{d}"] + self.w[f"b_{d}"]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            before, prior = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep:
                tape.append((i, f, o, g, before, prior, th))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores, batch by length by tags."""
        f, _ = self._run(x, "f", False)
        b, _ = self._run(x[:, ::-1], "b", False)
        return np.concatenate([f, b[::-1]], axis=2).transpose(1, 0, 2) @ self.w["out"] + self.w["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags ``y``, and its gradients."""
        n, length = x.shape
        w, g = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        f, tape_f = self._run(x, "f", True)
        b, tape_b = self._run(x[:, ::-1], "b", True)
        states = np.concatenate([f, b[::-1]], axis=2)
        e = states @ w["out"] + w["bias"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + w["first"]
        for t in range(1, length):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + w["trans"][None], 1) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = _lse(w["trans"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        gold = e[np.arange(length)[:, None], np.arange(n)[None], y.T].sum() + w["first"][y[:, 0]].sum() + w["trans"][y[:, :-1], y[:, 1:]].sum()
        g["first"] += de[0].sum(0)
        np.add.at(g["first"], y[:, 0], -1)
        for t in range(1, length):
            g["trans"] += np.exp(alpha[t - 1][:, :, None] + w["trans"][None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g["trans"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        de[np.arange(length)[:, None], np.arange(n)[None], y.T] -= 1
        g["out"] += np.einsum("tnh,tnk->hk", states, de)
        g["bias"] += de.sum((0, 1))
        ds = de @ w["out"].T
        for d, tape, xs, dh_all in (("f", tape_f, x, ds[:, :, : self.hidden]), ("b", tape_b, x[:, ::-1], ds[::-1, :, self.hidden :])):
            dh_next = dc = np.zeros((n, self.hidden), np.float32)
            for t in range(length - 1, -1, -1):
                i, fg, o, gg, before, prior, th = tape[t]
                dh = dh_all[t] + dh_next
                dc = dc + dh * o * (1 - th**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * fg * (1 - fg), dh * th * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                np.add.at(g[f"in_{d}"], xs[:, t], dz)
                g[f"re_{d}"] += prior.T @ dz
                g[f"b_{d}"] += dz.sum(0)
                dh_next, dc = dz @ w[f"re_{d}"].T, dc * fg
        return float((z.sum() - gold) / n), {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 56, rate: float = 0.02, seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, len(x)))
            _, g = self.gradients(x[at], y[at])
            size = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            for k, a in g.items():
                a *= min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one stretch (length by tags)."""
        score, back = e[0] + self.w["first"], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            step = score[:, None] + self.w["trans"]
            back[t] = step.argmax(0)
            score = step[back[t], np.arange(TAGS)] + e[t]
        tags = np.empty(len(e), np.int8)
        tags[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def _made_up(rng: np.random.Generator, kind: str, odd: float = 0.0) -> str:
    """A string of a kind, with probability ``odd`` written in a way that the base patterns do not know."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    strange = rng.random() < odd
    if kind == "email":
        tail = word() if rng.random() < 0.4 else d(rng.integers(0, 3))
        out = f"{word()}{rng.choice(['', '.', '_', '-'])}{tail}@{word()}{d(rng.integers(0, 2))}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de', 'info'])}".replace(".@", "@")
        if strange:
            ways = [(" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" [at] ", "."), ("{at}", "."), (" at ", " dot "), (" AT ", " DOT ")]
            at, dot = ways[rng.integers(0, len(ways))]
            name, host = out.split("@")
            out = name + at + host.replace(".", dot)
        return out
    if kind == "ip":
        return ["[.]", "(.)"][rng.integers(0, 2)].join(str(x) for x in rng.integers(0, 256, 4)) if strange else ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "phone":
        if strange:
            return str(rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{rng.integers(2, 10)}{d(2)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{rng.integers(2, 10)}{d(2)}.{d(3)}.{d(4)}", f"(0{d(2)}) {d(4)} {d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}"]))
        return f"+{rng.integers(1, 99)} " + rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(10)}"])
    body = str(rng.integers(3, 7)) + d(14)
    body += next(c for c in "0123456789" if luhn(body + c))
    gap = "." if strange else rng.choice(["", " ", "-"], p=[0.6, 0.2, 0.2])
    return gap.join(body[i : i + 4] for i in range(0, 16, 4))


def _distractor(rng: np.random.Generator) -> str:
    """Digits and ats that are nobody's data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = [d(rng.integers(1, 9)), f"20{d(2)}-0{rng.integers(1, 10)}-1{d(1)}", f"1{d(1)}/0{rng.integers(1, 10)}/19{d(2)}", f"{rng.integers(0, 9)}.{d(1)}.{d(2)}", f"${d(3)},{d(3)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", d(rng.integers(16, 40)), f"at {d(1)} or", f"{d(3)}-{d(3)}", f"@{d(2)}"]
    if rng.random() < 0.4:  # rows of numbers, book and order numbers
        size, n = int(rng.integers(1, 5)), int(rng.integers(3, 9))
        rows = [" ".join(d(size) for _ in range(n)), " ".join(str(x) for x in range(1, 3 + n)), "-".join(d(size) for _ in range(n))]
        forms = [*rows, f"97{d(1)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(3)}-{d(3)}-{d(4)}-{d(2)}", f"20{d(2)}-{d(4)}-{d(4)}", f"{d(4)}-{d(4)}-{d(2)}", f"{d(2)}.{d(6)}"]
    return forms[rng.integers(0, len(forms))]


def labelled(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for kind, s, e in spans:
        k = 1 + 2 * PERSONAL.index(kind)
        y[s], y[s + 1 : e] = k, k + 1
    return y


def training_set(samples: list[str], made: int = 1800, seed: int = 3, odd: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: sampled texts under the base patterns, and made-up strings set among sampled words."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    plain = [w for t in samples for w in t.split() if not _trigger.search(w)] or ["and", "the", "of", "to", "at", "call", "mail"]

    def put(text: str, y: np.ndarray) -> None:
        x = np.full(WINDOW, _PAD, np.uint8)
        x[: len(text)] = encode(text[:WINDOW])
        xs.append(x), ys.append(np.r_[y, np.zeros(WINDOW, np.int64)][:WINDOW])

    for text in samples:
        y = labelled(text, personal(text))
        for at in range(0, max(1, len(text) - WINDOW // 2), STRIDE):
            put(text[at : at + WINDOW], y[at : at + WINDOW])
    for _ in range(made):
        text, spans = made_up_text(rng, plain, odd)
        at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        put(text[at : at + WINDOW], labelled(text, spans)[at : at + WINDOW])
    return np.array(xs), np.array(ys)


def made_up_text(rng: np.random.Generator, plain: list[str], odd: float) -> tuple[str, list[tuple[str, int, int]]]:
    """A line of words, strings of the kinds and distractors, and where the strings stand."""
    words = lambda n: [(str(w), "") for w in rng.choice(plain, n)]
    parts = words(rng.integers(0, 4))
    for _ in range(rng.integers(1, 4)):
        kind = str(rng.choice(PERSONAL))
        parts.append((_made_up(rng, kind, odd), kind))
        parts += words(rng.integers(0, 2))
    parts += words(rng.integers(0, 3))
    for _ in range(rng.integers(0, 3)):
        parts.insert(int(rng.integers(0, len(parts) + 1)), (_distractor(rng), ""))
    text, spans = "", []
    for s, kind in parts:
        if kind:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s + str(rng.choice([" ", ", ", ". ", ": ", " (", ") ", "! ", "; ", "=", "\n"], p=[0.6, 0.08, 0.08, 0.08, 0.03, 0.03, 0.02, 0.03, 0.02, 0.03]))
    return text, spans


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Train on the ``sample`` windows of the corpus with a trigger whose hashes are least, and made-up ones."""
    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                last = -1
                for m in _trigger.finditer(text):
                    if m.start() > last:
                        found.append(text[max(0, m.start() - 24) : m.start() + 72])
                        last = m.start() + 72
            yield pa.RecordBatch.from_pydict({"w": pa.array(found, pa.string())})

    windows = rows.mapInArrow(cut, "w string").withColumn("h", F.xxhash64("w")).orderBy("h", "w").limit(sample)
    return Tagger().train(*training_set([r.w for r in windows.collect()]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Maximal parts of the text covered by windows: every trigger with ``MARGIN`` characters around it."""
    out: list[list[int]] = []
    for m in _trigger.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _decoded(model: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Tags of each text: window scores averaged by centrality, then one Viterbi pass."""
    where, xs = [], []
    codes = [encode(t) for t in texts]
    for k, code in enumerate(codes):
        for at in range(0, max(1, len(code) - WINDOW + STRIDE), STRIDE):
            x = np.full(WINDOW, _PAD, np.uint8)
            part = code[at : at + WINDOW]
            x[: len(part)] = part
            where.append((k, at, len(part))), xs.append(x)
    total = [np.zeros((len(c), TAGS), np.float32) for c in codes]
    weight = [np.zeros((len(c), 1), np.float32) for c in codes]
    central = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)[:, None]
    for lo in range(0, len(xs), 512):
        for (k, at, n), e in zip(where[lo : lo + 512], model.emissions(np.array(xs[lo : lo + 512]))):
            total[k][at : at + n] += e[:n] * central[:n]
            weight[k][at : at + n] += central[:n]
    return [model.viterbi(t / w) if len(t) else np.zeros(0, np.int8) for t, w in zip(total, weight)]


def decode(model: Tagger, texts: list[str], piece: int = PIECE) -> list[np.ndarray]:
    """Tags of each stretch. Stretches go in batches of about ``piece`` characters, and one longer than that in overlapping pieces."""
    jobs = [(k, at) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - OVERLAP), piece)]
    out = [np.zeros(len(t), np.int8) for t in texts]
    lo = 0
    while lo < len(jobs):
        hi, held = lo, 0
        while hi < len(jobs) and (hi == lo or held < piece):
            k, at = jobs[hi]
            held += min(len(texts[k]) - at, piece + OVERLAP)
            hi += 1
        for (k, at), tags in zip(jobs[lo:hi], _decoded(model, [texts[k][at : at + piece + OVERLAP] for k, at in jobs[lo:hi]])):
            skip = OVERLAP // 2 if at else 0  # the piece before has decided these
            out[k][at + skip : at + len(tags)] = tags[skip:]
        lo = hi
    return out


def added(text: str, base: list[tuple[str, int, int]], parts: list[tuple[int, int]], tags: list[np.ndarray]) -> list[tuple[str, int, int]]:
    """Decoded spans that are of their kind and touch no base span."""
    out = []
    taken: list[list[int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    begins = [s for s, _ in taken]
    for (start, _), y in zip(parts, tags):
        inside = y > 0
        first = inside & ((y % 2 == 1) | ~np.r_[False, inside[:-1]] | (np.r_[0, y[:-1]] + 1 < y) | (np.r_[0, y[:-1]] > y))
        for t in np.flatnonzero(first).tolist():
            k, e = (int(y[t]) - 1) // 2, t + 1
            while e < len(y) and y[e] == 2 * k + 2:
                e += 1
            kind, s = PERSONAL[k], text[start + t : start + e]
            left = len(s) - len(s.lstrip(" ,;:"))
            s = s.strip(" ,;:.-")
            at = start + t + left
            before = bisect_left(begins, at + len(s)) - 1
            if s and plausible(kind, s) and (before < 0 or taken[before][1] <= at):
                out.append((kind, at, at + len(s)))
    return out


def find(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (base spans), n_added, n_personal (all spans), base_sha256, spans.

    ``spans`` holds base and added spans, kind:start:end in code points, by kind and then start. Null and empty
    texts have none. Repeated rows and null ids are treated each on their own; an empty table gives no rows;
    other columns are not read, whatever their names. Texts of any length are decoded whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [*(f"n_{k}" for k in PERSONAL), "n_added", "n_personal"]
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string"

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [personal(t) for t in texts]
                parts = [stretches(t) for t in texts]
                flat = iter(decode(held.value, [t[s:e] for t, p in zip(texts, parts) for s, e in p]))
                more = [added(t, b, p, [next(flat) for _ in p]) for t, b, p in zip(texts, base, parts)]
                every = [sorted(b + m, key=lambda x: (PERSONAL.index(x[0]), x[1])) for b, m in zip(base, more)]
                out = {"doc_id": batch.column("doc_id")}
                out |= {f"n_{k}": pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in PERSONAL}
                out |= {"n_added": pa.array([len(m) for m in more], pa.int64()), "n_personal": pa.array([len(x) for x in every], pa.int64()), "base_sha256": pa.array([digest(b) for b in base]), "spans": pa.array([joined(s) for s in every])}
                yield pa.RecordBatch.from_pydict(out)

    return narrow.mapInArrow(tag, schema).withColumnRenamed("doc_id", id_col)
