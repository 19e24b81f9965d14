"""Secret scan: fixed patterns and a character convolutional network over candidates.

One pass labels tokens: those that hold a pattern's value are findings, plain words, ids and paths
are none; any other token has no label and is never learned from.  Two networks learn from every
distinct labelled token, each without the plain tokens of one fold, which it judges: first weights
come from one part of the tokens, then all parts go on from them side by side and their weights are
averaged.  Each finding is also seen with its characters drawn anew and in other
surroundings, so that the network learns the look of a token and not only the patterns' keywords.
A third of all tokens is held back to calibrate the output and to choose the highest
threshold that keeps the wanted recall.  A second pass judges every token of any length, long ones
by a moving window; those that reach the threshold and no pattern holds are added to the spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix, ship, text_chunks, worker_cache, written

ship(__name__)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so this equals runs of 16 and more
#: Bytes of HEX as "x": a text without a run of them is not searched.
_HEXES, _HEX_RUN = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256)), b"x" * 16
#: Any token may be a secret; the network tells.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
_PART = r"(?:[A-Z]?[a-z]++[0-9]{0,4}+|[A-Z]++[0-9]{0,4}+|[0-9]++)"
#: Plain words, ids and paths: what the network learns as no secret.
PLAIN = re.compile(rf"[/_=+-]*+{_PART}(?:[/_=+-]++{_PART})*+[/_=+-]*+")
KINDS = ("assign", "access", "hex", "model")

LEFT, BODY, RIGHT = 24, 48, 8
#: The window moves over a longer token by so many characters.
STRIDE = 24
#: Least overlap with a pattern's value for a token to be learned as a finding.
LEAST_VALUE = 12
WIDTH = LEFT + BODY + RIGHT
EMBED, KERNEL, FILTERS = 8, 5, 24
#: Different characters that the network tells apart.
CODES = 98
#: Places of the kernel within a window besides one for each character of the token.
AROUND = LEFT + RIGHT - KERNEL + 1
#: Characters that are convolved together.
STEP = 4096
#: Where windows are bounded: places whose activations are seen as their largest one, places that are
#: convolved together, and how many times as many whose windows are bounded together.
CELL, BOUND_STEP, BOUND_BLOCKS = 8, 2048, 16
#: Rows with shorter tokens are learned apart from the others of their step: less of their window is looked at.
SHORT = 12
#: Plain tokens of a part, on average; parts are learned side by side.
PART = 16384
#: Plain tokens that a task holds before it sends them: bounds its memory only.
HELD = 1 << 18
#: Findings that a part has, on average, if there are so many: a finding is in several parts then.
FOUND = 64
#: The first weights are learned from one part, over and over until it had so many rows.
FIRST_ROWS = 1 << 17
#: Step of the rest of the learning, one pass over all parts.
RATE = 0.002
#: Logits are counted in steps of 1 / GRID, up to LIMIT.
GRID, LIMIT = 256, 40
#: Part of the labelled findings that the threshold must keep.
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, code points, end exclusive."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):  # ASCII letters stay ASCII in lower()
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEXES):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]


def values(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans without the keywords before them."""
    found = []
    for s, kind, e in spans:
        m = ASSIGN.match(text, s) if kind == 0 else None
        found.append((m.start(2) if m else s, e))
    return found


def places(start: int, end: int) -> list[int]:
    """Where windows over a token start: all its characters are in the body of one."""
    return [start] if end - start <= BODY else [*range(start, end - BODY, STRIDE), end - BODY]


def overlapped(found: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each token (first overlapped character, number of them) in the span it overlaps most."""
    out, first = [], 0
    for s, e in found:  # both by start, without overlaps
        while first < len(spans) and spans[first][1] <= s:
            first += 1
        best = (s, 0)
        for at in range(first, len(spans)):
            s2, e2 = spans[at]
            if s2 >= e:
                break
            n = min(e, e2) - max(s, s2)
            best = max(best, (max(s, s2), n), key=lambda x: x[1])
        out.append(best)
    return out


def window(text: str, start: int, end: int) -> str:
    """Surroundings at fixed places: LEFT characters before ``start``, up to BODY of the token, what follows."""
    end = min(end, start + BODY)
    return (text[max(0, start - LEFT):start].rjust(LEFT, "\0") + text[start:end].ljust(BODY, "\0")
            + text[end:end + RIGHT].ljust(RIGHT, "\0"))


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_TOKEN = np.zeros(128, bool)
_TOKEN[[ord(c) for c in "+/_=-"]] = True
for _first, _last in ("09", "AZ", "az"):
    _TOKEN[ord(_first):ord(_last) + 1] = True


class Tokens:
    """All tokens of several texts as places in one array of characters.

    Texts stand LEFT empty characters apart; WIDTH of them follow the last.
    """

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        gap = "\0" * LEFT
        self.text = gap + gap.join(texts) + "\0" * WIDTH
        self.flat = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.begins = LEFT + np.cumsum([0] + [len(t) + LEFT for t in texts])
        letters = (self.flat < 128) & _TOKEN[np.minimum(self.flat, 127)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], letters.view(np.int8), [0]])))
        self.starts, self.ends = edges[::2], edges[1::2]
        held = np.zeros(len(self.flat) + 1, np.int32)
        for begin, own in zip(self.begins.tolist(), spans):
            for s, _, e in own:
                held[begin + s + 1:begin + e + 1] = 1
        held = np.cumsum(held)
        #: Tokens without a character in a span.
        self.free = held[self.ends] == held[self.starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of tokens, and of tokens with their surroundings."""
        powers, inverse = _powers(len(self.flat))
        sums = np.zeros(len(self.flat) + 1, U64)
        np.cumsum(_SCRAMBLED[self.flat & 0xFFFF] * powers, out=sums[1:])
        first = starts - LEFT
        return (mix((sums[ends] - sums[starts]) * inverse[starts]),
                mix((sums[ends + RIGHT] - sums[first]) * inverse[first]))

    def place(self, start: int, end: int) -> tuple[int, int, int]:
        """Text, start and end within it."""
        no = int(np.searchsorted(self.begins, start, "right")) - 1
        return no, int(start - self.begins[no]), int(end - self.begins[no])


_BASE = 0x9E3779B97F4A7C15
_SCRAMBLED = mix(np.arange(1, 65537, dtype=U64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    held = worker_cache().get("secret_powers")
    if held is None or len(held[0]) < n:
        held = tuple(np.cumprod(np.append(U64(1), np.full(n - 1, base, U64)), dtype=U64)
                     for base in (_BASE, pow(_BASE, -1, 1 << 64)))
        if n <= 1 << 22:
            worker_cache()["secret_powers"] = held
    return held[0][:n], held[1][:n]


class Seen:
    """Tokens that were sent, with the least window of each.  Its room is fixed: what is forgotten is sent again."""

    def __init__(self, bits: int = 20):
        self.shift = U64(64 - bits)
        self.token, self.least = np.zeros(1 << bits, U64), np.full(1 << bits, 2 ** 64 - 1, U64)

    def new(self, token: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Places of the least window of each token that has none as small yet."""
        slot = (token >> self.shift).astype(np.int64)
        at = np.flatnonzero((self.token[slot] != token) | (self.least[slot] > around))
        at = at[np.lexsort((around[at], token[at]))]
        at = at[np.append(True, token[at[1:]] != token[at[:-1]])] if len(at) else at
        self.token[slot[at]], self.least[slot[at]] = token[at], around[at]
        return at


#: A labelled window: ``token`` and ``place`` are hashes of the token and of its surroundings.
_LABELLED = pa.schema([("found", pa.bool_()), ("fold", pa.int32()), ("token", pa.int64()), ("place", pa.int64()),
                       ("w", pa.string())])


def labelled(texts: list[str], seen: Seen) -> Iterator[tuple[bool, int, int, int, str]]:
    """Rows of ``_LABELLED`` of all findings, and of every plain token in its least window, unless sent before."""
    spans = [base_spans(t) for t in texts]
    for text, own in zip(texts, spans):
        if own:
            found = candidates(text)
            for (s, e), (at, held) in zip(found, overlapped(found, _merged(values(text, own)))):
                if held >= LEAST_VALUE:
                    token = hashlib.blake2b(text[s:e].encode(), digest_size=8).digest()
                    yield True, 0, int.from_bytes(token, "little", signed=True), 0, window(text, at if e - s > BODY else s, e)
    tokens = Tokens(texts, spans)
    starts, ends = tokens.starts[tokens.free], tokens.ends[tokens.free]
    token, around = tokens.hashes(starts, ends)
    new = seen.new(token, around)
    starts, ends, token, around = (x[new] for x in (starts, ends, token, around))
    text, room = tokens.text, ["\0" * n for n in range(BODY, -1, -1)]
    for s, e, t, h in zip(starts.tolist(), ends.tolist(), token.view(np.int64).tolist(),
                          (around ^ U64(1 << 63)).view(np.int64).tolist()):  # in the same order, signed
        if PLAIN.fullmatch(text, s, e):
            own = text[s:e]
            if e - s <= BODY:  # no text ends within LEFT or RIGHT characters of another
                w = text[s - LEFT:e] + room[e - s] + text[e:e + RIGHT]
            else:
                starts_at = places(s, e)
                w = window(text, starts_at[h % len(starts_at)], e)
            yield False, fold(own), t, h, w


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one, by start."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Findings and plain tokens; of these only the least window of HELD tokens is sent."""
    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _LABELLED)],
                               schema=_LABELLED)

    seen, least = Seen(), {}
    for batch in batches:
        for first, last, _, _ in text_chunks(batch):
            found = []
            for row in labelled([t or "" for t in batch.column(1).slice(first, last - first).to_pylist()], seen):
                if row[0]:
                    found.append(row)
                elif row[2] not in least or row[3:] < least[row[2]][3:]:
                    least[row[2]] = row
            yield sent(found)
            if len(least) >= HELD:
                yield sent(list(least.values()))
                least.clear()
    yield sent(list(least.values()))


def fold(token: str) -> int:
    """A token is judged by the network of its fold, which no plain token of the fold was learned by."""
    return zlib.crc32(token.encode()) & 1


def _numbers(flat: np.ndarray) -> np.ndarray:
    """Characters as small numbers: printable ASCII as itself, other letters and the rest apart."""
    return np.where(flat == 0, 0, np.where((flat >= 32) & (flat < 127), flat - 31, np.where(flat > 127, 96, 97))).astype(np.int64)


def coded(windows: list[str]) -> np.ndarray:
    """Windows as they stand in a text: surroundings and token without the room left between them.

    The last column is the length of the token; what follows the window is masked by it.
    """
    flat = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), WIDTH)
    length = (flat[:, LEFT:LEFT + BODY] != 0).sum(axis=1)
    at = np.arange(WIDTH)
    source = np.where(at < LEFT + length[:, None], at, at + BODY - length[:, None])
    numbers = np.take_along_axis(_numbers(flat), np.minimum(source, WIDTH - 1), axis=1)
    return np.concatenate([np.where(source < WIDTH, numbers, 0), length[:, None]], axis=1)


class Network:
    """Embedding, one convolution with a rectifier, the largest and mean activation, a logistic unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 0.3, (CODES, EMBED)), rng.normal(0, 0.2, (KERNEL * EMBED, FILTERS)),
                  np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1
        #: Share of findings among the held-back rows that the threshold lets pass.
        self.precision: float | None = None

    def _forward(self, codes: np.ndarray):
        embed, kernel, bias, out, last = self.w
        length = codes[:, WIDTH, None]
        n = int(length.max()) + AROUND  # no token of these reaches further
        x = np.take(embed, codes[:, :n + KERNEL - 1], axis=0)
        patches = np.concatenate([x[:, k:n + k] for k in range(KERNEL)], axis=2)
        place = np.arange(n)
        inside = (place < length + AROUND)[:, :, None]
        # only the part that starts within the token is averaged
        share = ((place >= LEFT) & (place < LEFT + length))[:, :, None] / np.maximum(length, 1)[:, :, None].astype(embed.dtype)
        active = patches.reshape(-1, KERNEL * EMBED) @ kernel
        active += bias
        active = np.maximum(active, np.zeros_like(active), out=active).reshape(len(codes), n, FILTERS)  # much faster than with a number
        active *= inside
        mean = np.matmul(share.transpose(0, 2, 1), active)[:, 0]
        pooled = np.concatenate([active.max(axis=1), mean], axis=1)
        return patches, active, share, pooled, pooled @ out + last

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out, order = np.zeros(len(codes)), np.argsort(codes[:, WIDTH], kind="stable")
        for i in range(0, len(codes), 256):
            out[order[i:i + 256]] = self._forward(codes[order[i:i + 256]])[4]
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.shift, -30, 30)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.01, size: int = 64,
            seed: int = 11) -> None:
        """Findings weigh half as much as the rest at least."""
        rng = np.random.default_rng(seed)
        weights = np.where(labels == 1, max(1.0, (labels == 0).sum() / max(1, 2 * (labels == 1).sum())), 1.0)
        self.w = [w.astype(np.float32) for w in self.w]
        mean, square, step = [0 * w for w in self.w], [0 * w for w in self.w], 0
        short = codes[:, WIDTH] <= SHORT
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), size):
                rows = order[at:at + size]
                parts = [r for r in (rows[short[rows]], rows[~short[rows]]) if len(r)]
                grads = [self._gradient(codes[r], labels[r], weights[r] / len(rows)) for r in parts]
                for i, g in enumerate(grads[0] if len(grads) == 1 else [a + b for a, b in zip(*grads)]):
                    g = g + 1e-4 * self.w[i] if i == 1 else g
                    mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
                step += 1
                for i in range(len(self.w)):
                    self.w[i] = self.w[i] - np.float32(rate) * (mean[i] / (1 - 0.9 ** step)) / (
                        np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w = [w.astype(float) for w in self.w]

    def _gradient(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> list[np.ndarray]:
        """Of the mean loss and the kernel's decay; given ``weights``, of the loss weighed by them alone."""
        embed, kernel, _, out, _ = self.w
        patches, active, share, pooled, logit = self._forward(codes)
        decay = 1e-4 * kernel if weights is None else 0
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * (
            1 / len(codes) if weights is None else weights)).astype(embed.dtype)
        grad = [None, None, None, pooled.T @ error, np.array([error.sum()])]
        to_active = error[:, None, None] * out[FILTERS:] * share
        top = active.argmax(axis=1)
        n, f = np.ogrid[:len(codes), :FILTERS]
        to_active[n, top, f] += error[:, None] * out[:FILTERS]
        to_active *= active > 0
        flat = to_active.reshape(-1, FILTERS)
        grad[1] = patches.reshape(-1, KERNEL * EMBED).T @ flat + decay
        grad[2] = flat.sum(axis=0)
        to_patches = to_active @ kernel.T
        size = to_patches.shape[1]
        to_x = np.zeros((len(codes), size + KERNEL - 1, EMBED), embed.dtype)
        for k in range(KERNEL):
            to_x[:, k:k + size] += to_patches[:, :, k * EMBED:(k + 1) * EMBED]
        own = codes[:, :size + KERNEL - 1].ravel()
        grad[0] = np.stack([np.bincount(own, to_x[:, :, i].ravel(), CODES) for i in range(EMBED)], axis=1).astype(embed.dtype)
        return grad

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float) -> None:
        self.calibrate_counted(self.logits(codes), labels, np.ones(len(labels)), recall)

    def calibrate_counted(self, z: np.ndarray, labels: np.ndarray, count: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold with the wanted recall, of logits met ``count`` times."""
        y = labels.astype(float)
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, d = count * p * (1 - p), count * (p - y)
            g = np.array([(d * z).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
            h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
            move = np.linalg.solve(h, g)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
        self.scale, self.shift = max(a, 1e-3), b
        p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
        found = np.flatnonzero(y == 1)
        found = found[np.argsort(p[found])]
        below = np.cumsum(count[found])
        self.threshold = float(p[found[np.searchsorted(below, int((1 - recall) * below[-1]), "right")]]) if len(found) else 1.1
        passed = p >= self.threshold
        self.precision = float((count * y)[passed].sum() / count[passed].sum()) if passed.any() else None


def _redrawn(windows: list[str], rng: np.random.Generator, plain: list[str]) -> list[str]:
    """Findings with the same length and other characters, half of them without what stands before,
    half of those amid what surrounds plain tokens."""
    sets = ["0123456789abcdef", "0123456789ABCDEF",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-"]
    out = []
    for text in windows:
        letters = sets[rng.integers(len(sets))]
        body = text[LEFT:LEFT + BODY].rstrip("\0")
        drawn = "".join(letters[i] for i in rng.integers(0, len(letters), len(body)))
        left, right, place = text[:LEFT], text[LEFT + BODY:], rng.random()
        right = "\0" * RIGHT if rng.random() < 0.25 else right
        if place < 0.25:
            left = "\0" * LEFT
        elif place < 0.5:
            other = plain[rng.integers(len(plain))]
            left, right = other[:LEFT], other[LEFT + BODY:]
        out.append(left + drawn.ljust(BODY, "\0") + right)
    return out


def _joined(windows: list[str], rng: np.random.Generator) -> list[str]:
    """Ids and paths made of plain tokens, where these stand: with a number, or several of them joined."""
    bodies = [w[LEFT:LEFT + BODY].rstrip("\0") for w in windows]
    out = []
    for text, body in zip(windows, bodies):
        number = str(rng.integers(10 ** rng.integers(1, 5)))
        others = [bodies[i] for i in rng.integers(0, len(bodies), rng.integers(1, 5))]
        mark = "/_-"[rng.integers(3)]
        made = body + number if rng.random() < 0.5 else mark.join([body, *others, number][:len(others) + 1 + rng.integers(2)])
        left = "\0" * LEFT if rng.random() < 0.25 else text[:LEFT]
        right = "\0" * RIGHT if rng.random() < 0.25 else text[LEFT + BODY:]
        out.append(left + made[:BODY].ljust(BODY, "\0") + right)
    return out


def examples(found: list[str], plain: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of windows and of what is made of them: redrawn findings, joined plain tokens."""
    copies = max(1, min(8, 2000 // max(1, len(found))))
    seen = found + ([w for _ in range(copies) for w in _redrawn(found, rng, plain)] if plain else [])
    copies = max(1, min(8, 2000 // max(1, len(plain))))
    # of many tokens every fourth
    plain = plain + [w for _ in range(copies) for w in _joined(plain[::4] if len(plain) > 4000 else plain, rng)]
    return coded(seen + plain), np.array([1.0] * len(seen) + [0.0] * len(plain))


def train(positive: list[str], negative: list[str], recall: float = RECALL) -> Network:
    """A calibrated network; without findings to learn from its threshold lets nothing pass."""
    network = Network()
    if not positive or not negative:
        return network
    rng = np.random.default_rng(5)
    held = np.arange(len(positive)) % 3 == 0 if len(positive) > 2 else np.zeros(len(positive), bool)
    own = [[w for w, h in zip(positive, held) if not h], [w for w, h in zip(positive, held) if h]]
    away = [negative[1::3] + negative[2::3] or negative, negative[0::3]]
    sets = [examples(found, plain, rng) for found, plain in zip(own, away)]
    network.fit(*sets[0])
    codes, labels = sets[1] if len(own[1]) else sets[0]
    network.calibrate(codes, labels, recall)
    return network


def _examples(table: pa.Table, networks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each network the examples of a part."""
    table = table.sort_by([("found", "ascending"), ("token", "ascending")])
    rows = list(zip(*(table.column(c).to_pylist() for c in ("found", "fold", "w"))))
    rng = np.random.default_rng(table.column("part")[0].as_py())
    for no in range(networks):
        found, plain = [w for f, _, w in rows if f], [w for f, own, w in rows if not f and own != no]
        yield examples(found, plain, rng) if found or plain else (np.zeros((0, WIDTH + 1), np.int64), np.zeros(0))


_WEIGHTS = pa.schema([("net", pa.int32()), ("w", pa.list_(pa.float64()))])
_LOGITS = pa.schema([("net", pa.int32()), ("label", pa.int32()), ("z", pa.int64()), ("n", pa.int64())])


def _learn(networks: list[Network], rate: float, first: bool):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for network, (codes, labels) in zip(networks, _examples(table, len(networks))):
            own = Network()
            own.w = network.w
            if len(codes):
                own.fit(codes, labels, max(1, min(12, FIRST_ROWS // len(codes))) if first else 1, rate, 64 if first else 256)
            out.append(np.concatenate([w.ravel() for w in own.w]))
        return pa.table([range(len(out)), out], schema=_WEIGHTS)
    return run


def _count_logits(networks: list[Network]):
    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for no, (network, (codes, labels)) in enumerate(zip(networks, _examples(table, len(networks)))):
            network.w = [w.astype(np.float32) for w in network.w]  # a task's own copy
            z = np.floor(np.clip(network.logits(codes), -LIMIT, LIMIT) * GRID).astype(np.int64)
            for label in (0, 1):
                out += [(no, label, *x) for x in zip(*(a.tolist() for a in np.unique(z[labels == label], return_counts=True)))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, _LOGITS)], schema=_LOGITS)
    return run


def _learned(rows: DataFrame, networks: list[Network], rate: float, first: bool) -> None:
    """Weights learned in all parts of ``rows``, averaged; as integers, whose sum has no order."""
    parts = rows.groupBy("part").applyInArrow(_learn(networks, rate, first), "net int, w array<double>")
    sums = parts.select("net", F.posexplode("w").alias("at", "w")).groupBy("net", "at").agg(
        F.sum(F.round(F.col("w") * 2.0 ** 32).cast("bigint")).alias("w"), F.count("*").alias("n")).orderBy("net", "at").collect()
    for no, network in enumerate(networks):
        flat = np.array([r["w"] / r["n"] for r in sums if r["net"] == no]) / 2.0 ** 32
        cuts = np.cumsum([w.size for w in network.w])[:-1]
        network.w = [x.reshape(w.shape) for x, w in zip(np.split(flat, cuts), network.w)]


def train_all(rows: DataFrame, recall: float = RECALL) -> list[Network]:
    """Two networks learned from and calibrated by all ``rows``: found, fold, token, w of each distinct token.

    A third is held back, if that has a finding and the rest has one.
    """
    networks = [Network(), Network()]
    rows = rows.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(3)) == 0)
    n = rows.agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("plain"),
                 F.count_if(F.col("found") & F.col("held")).alias("held")).first()
    if not n["found"] or not n["plain"]:
        return networks
    parts = -(-n["plain"] // PART)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("token", F.lit("part")), F.lit(parts)))
    whole = n["held"] in (0, n["found"])
    learned, held = (rows, rows) if whole else (rows.where(~F.col("held")), rows.where("held"))
    copies = min(parts, -(-FOUND * parts // n["found"]))
    learned = learned.withColumn("part", F.explode(F.when(F.col("found"), F.transform(
        F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(F.col("part") + i, F.lit(parts)))).otherwise(F.array("part"))))
    _learned(learned.where("part = 0"), networks, 0.01, True)
    if parts > 1:
        _learned(learned.repartition(parts, "part"), networks, RATE, False)
    counted = held.repartition(parts, "part").groupBy("part").applyInArrow(
        _count_logits(networks), "net int, label int, z bigint, n bigint")
    counted = counted.groupBy("net", "label", "z").agg(F.sum("n").alias("n")).orderBy("net", "z", "label").collect()
    for no, network in enumerate(networks):
        z, label, count = np.array([(r["z"], r["label"], r["n"]) for r in counted if r["net"] == no], float).reshape(-1, 3).T
        network.calibrate_counted(z / GRID, label, count, recall)
    return networks


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                     ("base_spans", pa.string()), ("spans", pa.string())])


def _logit(p: float) -> float:
    """Of a probability as :meth:`Network.probability` has them; the least one is that of any small logit."""
    return np.inf if p >= 1 else -np.inf if p < 1e-13 else float(np.log(p / (1 - p)))


class Scanner:
    """The networks over whole texts: every character is convolved once.

    Embedding and kernel become tables of what one or two characters add to the filters, so the
    convolution adds three rows a character.  Windows are bounded first: filters that raise a logit
    count by the cells that a window touches, the others by the cells within it.  Those that may
    reach the threshold are convolved again; such a window takes its maximum from two overlapping
    maxima of a power-of-two length.  The share of the mean is one of running sums in both.
    """

    def __init__(self, networks: list[Network]):
        self.networks = networks
        one = [np.concatenate([n.w[0] @ n.w[1][k * EMBED:(k + 1) * EMBED] for n in networks], axis=1) for k in range(KERNEL)]
        two = [(one[k][:, None] + one[k + 1]).reshape(CODES * CODES, -1) for k in (0, 2)]
        self.tables = [t.astype(np.float32) for t in (*two, one[4] + np.concatenate([n.w[2] for n in networks]))]
        #: What the mean activation adds to each network's logit.
        self.mean = np.zeros((len(networks) * FILTERS, len(networks)), np.float32)
        for i, n in enumerate(networks):
            self.mean[i * FILTERS:(i + 1) * FILTERS, i] = n.w[3][FILTERS:]
        self.off = all(n.threshold > 1 for n in networks)
        largest = np.concatenate([n.w[3][:FILTERS] for n in networks])
        order = np.argsort(largest < 0, kind="stable")
        #: Filters that raise a logit; the tables have them first here.
        self.raising = int((largest >= 0).sum())
        self.ordered = [np.ascontiguousarray(t[:, order]) for t in self.tables]
        self.ordered_mean = np.ascontiguousarray(self.mean[order])
        self.largest = np.where(np.repeat(np.arange(len(networks)), FILTERS)[:, None] == np.arange(len(networks)),
                                largest[:, None], 0).astype(np.float32)[order]
        # bounds count activations, sums of three entries, in steps of 1 / scale: half a step is lost in each
        most = sum(np.abs(t).max(axis=0) for t in self.ordered)
        scale = 32000 / max(float(most.max()), 1e-6)
        # far more than what logits lose in single precision, and the steps
        slack = 1e-4 + (1e-4 * most + 1.6 / scale) @ (np.abs(self.largest) + np.abs(self.ordered_mean))
        #: No window with a smaller bound reaches the threshold; a probability near 1 tells its logit to 0.001.
        self.least = np.array([_logit(n.threshold) - 0.01 - n.shift for n in networks]) / [n.scale for n in networks] - slack
        self.ordered = [np.rint(t * scale).astype(np.int16) for t in self.ordered]
        self.largest, self.ordered_mean = self.largest / np.float32(scale), self.ordered_mean / np.float32(scale)

    def passed(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each token of ``flat`` and each network whether a window over it reaches the threshold.

        ``flat`` has LEFT empty characters before the first token and WIDTH after the last.
        """
        out = np.zeros((len(starts), len(self.networks)), bool)
        if self.off or not len(starts):
            return out
        numbers = _numbers(flat)
        size = np.minimum(ends - starts, BODY)
        first, token = starts, np.arange(len(starts))
        long = np.flatnonzero(ends - starts > BODY)
        if len(long):
            more = [(p, t) for t in long.tolist() for p in places(int(starts[t]), int(ends[t]))[1:]]
            first = np.concatenate([first, [p for p, _ in more]])
            token = np.concatenate([token, [t for _, t in more]])
            size = np.concatenate([size, np.full(len(more), BODY)])
            order = np.argsort(first, kind="stable")
            first, token, size = first[order], token[order], size[order]
        first = first - LEFT  # windows begin with what stands before the token
        left = np.flatnonzero(self._bounded(numbers, first, size))
        first, size, token = first[left], size[left], token[left]
        own = size + LEFT + RIGHT  # windows that are left, one after the other
        ends = np.cumsum(own)
        numbers = np.append(numbers[np.repeat(first - (ends - own), own) + np.arange(own.sum())], np.zeros(WIDTH, numbers.dtype))
        first = ends - own
        cuts = np.searchsorted(first, np.arange(0, len(numbers) + STEP, STEP))
        for block, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a < b:
                high = self._block(numbers[block * STEP:(block + 1) * STEP + WIDTH], first[a:b] - block * STEP, size[a:b])
                np.logical_or.at(out, token[a:b][high.any(axis=1)], high[high.any(axis=1)])
        return out

    def _bounded(self, numbers: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which windows may reach a threshold, by a bound that no logit exceeds."""
        out = np.zeros(len(first), bool)
        step = BOUND_STEP * BOUND_BLOCKS
        numbers = np.append(numbers, np.zeros(BOUND_STEP + WIDTH + KERNEL, numbers.dtype))
        cuts = np.searchsorted(first, np.arange(0, len(numbers) + step, step))
        for block, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a < b:
                at = block * step
                n = -(-(int(first[b - 1]) - at + WIDTH) // BOUND_STEP) * BOUND_STEP
                n = min(n, (len(numbers) - at - KERNEL) // CELL * CELL)
                out[a:b] = self._may_pass(*self._cells(numbers[at:at + n + KERNEL], n), first[a:b] - at, size[a:b])
        return out

    def _cells(self, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest activations of each cell of ``n`` places, and running sums of what their mean adds."""
        pairs = numbers[:-1] * CODES + numbers[1:]
        out = np.empty((n // CELL, len(self.largest)), np.int16)
        sums = np.zeros((n + 1, len(self.networks)))
        active, more, none = (np.zeros((min(n, BOUND_STEP), len(self.largest)), np.int16) for _ in range(3))
        for at in range(0, n, BOUND_STEP):
            size = min(n - at, BOUND_STEP)
            active, more, none = active[:size], more[:size], none[:size]
            # the first places of all cells, then the second ones, and so on
            places = [x[at + k:at + k + size].reshape(-1, CELL).T.ravel() for x, k in ((pairs, 0), (pairs, 2), (numbers, 4))]
            np.take(self.ordered[0], places[0], axis=0, out=active, mode="clip")
            for table, own in zip(self.ordered[1:], places[1:]):
                np.add(active, np.take(table, own, axis=0, out=more, mode="clip"), out=active)
            np.maximum(active, none, out=active)  # much faster than with a number
            mean = (active.astype(np.float32) @ self.ordered_mean).reshape(CELL, size // CELL, -1)
            sums[at + 1:at + size + 1].reshape(size // CELL, CELL, -1)[:] = mean.transpose(1, 0, 2)
            top = active.reshape(CELL, size // CELL, -1)
            while len(top) > 1:
                top = np.maximum(top[:len(top) // 2], top[len(top) // 2:])
            out[at // CELL:(at + size) // CELL] = top[0]
        return out, np.cumsum(sums, axis=0, out=sums)

    def _may_pass(self, cell: np.ndarray, sums: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        end = first + size + AROUND
        bound = (sums[first + LEFT + size] - sums[first + LEFT]) / size[:, None] + [n.w[4][0] for n in self.networks]
        left = np.arange(len(first))
        for column, low, high in ((slice(0, self.raising), first // CELL, (end - 1) // CELL + 1),  # cells that are touched
                                  (slice(self.raising, None), -(-first // CELL), end // CELL)):  # cells within: 2 or more
            top, reach = np.ascontiguousarray(cell[:, column]), 1
            low, cells = low[left], (high - low)[left]
            while reach <= int(cells.max(initial=0)):
                own = np.flatnonzero((cells >= reach) & (cells < 2 * reach))
                if len(own):
                    both = np.take(top, low[own], axis=0)
                    np.maximum(both, np.take(top, low[own] + cells[own] - reach, axis=0), out=both)
                    bound[left[own]] += both.astype(np.float32) @ self.largest[column]
                top = np.maximum(top[:max(0, len(top) - reach)], top[reach:])
                reach *= 2
            left = left[(bound[left] >= self.least).any(axis=1)]
        may = np.zeros(len(first), bool)
        may[left] = True
        return may

    def _block(self, numbers: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = len(numbers) - KERNEL + 1
        pairs = numbers[:-1] * CODES + numbers[1:]
        active = np.take(self.tables[0], pairs[:n], axis=0)
        active += np.take(self.tables[1], pairs[2:n + 2], axis=0)
        active += np.take(self.tables[2], numbers[4:n + 4], axis=0)
        np.maximum(active, np.zeros_like(active), out=active)
        sums = np.zeros((n + 1, len(self.networks)))
        np.cumsum(active @ self.mean, axis=0, dtype=float, out=sums[1:])
        wide = size + AROUND
        largest = np.empty((len(first), active.shape[1]), np.float32)
        top, reach = active, 1
        while reach <= int(wide.max()):
            if reach > 1:
                top = np.maximum(top[:len(top) - reach // 2], top[reach // 2:])
            own = np.flatnonzero((wide >= reach) & (wide < 2 * reach))
            if len(own):
                largest[own] = np.maximum(top[first[own]], top[first[own] + wide[own] - reach])
            reach *= 2
        mean = (sums[first + LEFT + size] - sums[first + LEFT]) / size[:, None]
        high = np.empty((len(first), len(self.networks)), bool)
        for i, net in enumerate(self.networks):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            z = largest[:, own] @ net.w[3][:FILTERS].astype(np.float32) + mean[:, i] + net.w[4]
            high[:, i] = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30))) >= net.threshold
        return high

    def found(self, texts: list[str], spans: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """The spans that the networks add to each text: tokens without a character in a span of it."""
        tokens = Tokens(texts, spans)
        starts, ends = tokens.starts[tokens.free], tokens.ends[tokens.free]
        passed = self.passed(tokens.flat, starts, ends)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for at in np.flatnonzero(passed.any(axis=1)).tolist():
            no, s, e = tokens.place(starts[at], ends[at])
            if passed[at, fold(texts[no][s:e])]:
                out[no].append((s, 3, e))
        return out


def _judge(networks: list[Network]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(networks)
        for batch in batches:
            ids = batch.column(0)
            for first, last, _, _ in text_chunks(batch):
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                spans = [base_spans(t) for t in texts]
                rows: list[list] = [[] for _ in _RESULT]
                for doc, own, more in zip(ids.slice(first, last - first).to_pylist(), spans, scanner.found(texts, spans)):
                    kinds = [k for _, k, _ in own]
                    for column, value in zip(rows, (doc, *(kinds.count(k) for k in range(3)), render(own),
                                                    render(own + more))):
                        column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _RESULT)], schema=_RESULT)
    return run


def scan_secrets(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans for every row of ``docs``.

    ``base_spans`` are the pattern matches as kind:start:end (code points, end exclusive) by
    start, ``spans`` has the network's findings as well, of kind model; these never overlap a
    pattern match.  Null and empty texts have none.  Null ids and repeated rows are rows like
    any other.  Texts are read whole.  Where no row has a finding the network adds nothing.
    Further columns are not looked at; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # dealt out before they are merged: few rows of a task are of one token
    rows = texts.mapInArrow(_label, "found boolean, fold int, token bigint, place bigint, w string").repartition(
        "found", "token").groupBy("found", "token").agg(F.min(F.struct("place", "fold", "w")).alias("least"))
    networks = train_all(written(rows.select("found", "token", "least.fold", "least.w"), "labelled"), recall)
    return texts.mapInArrow(_judge(networks), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                            "base_spans string, spans string")
