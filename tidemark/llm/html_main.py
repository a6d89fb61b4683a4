"""Main-text extraction: a bidirectional LSTM labels every block of a page.

A page is a sequence of blocks. Each block is a vector of its hashed tag path, its hashed words and
a few measures; a recurrent net reads the sequence both ways, so a block's label rests on the whole
page. The net is trained here, on pages made by a generator that knows which blocks are article.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.html_blocks import blocks
from tidemark.llm.shared import give_back
from tidemark.llm.tokens import split_words

PATH_SLOTS, WORD_SLOTS, MEASURES = 512, 32, 6
INPUTS = PATH_SLOTS + WORD_SLOTS + MEASURES
HIDDEN = 16
TRAINING_PAGES = 800
EPOCHS = 16
PAGES_AT_ONCE = 256
#: Positions, with padding, that the net reads at once; a page of more blocks goes alone.
POSITIONS = 4096

_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        v = np.zeros(PATH_SLOTS, dtype=np.float32)
        for token in (*path, "leaf " + " ".join(path[-1:])):
            v[zlib.crc32(token.encode()) % PATH_SLOTS] = 1
        _PATHS[path] = v
    return _PATHS[path]


def _vectors(flat: list[tuple[int, int, tuple]], length: np.ndarray) -> np.ndarray:
    """The input of each block ``(position, page, block)``; length is its page's number of blocks."""
    t = np.array([f[0] for f in flat])
    words, index, counts = split_words(pc.utf8_lower(pa.array([f[2][0] for f in flat], pa.large_string())))
    slots = np.fromiter((zlib.crc32(w.encode()) % WORD_SLOTS for w in words.to_pylist()), dtype=np.int64, count=len(words))
    bag = np.bincount(np.repeat(np.arange(len(flat)), counts) * WORD_SLOTS + slots[index], minlength=len(flat) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
    sizes = np.array([len(f[2][0]) for f in flat])
    measures = np.stack([np.log1p(sizes) / 8, np.log1p(counts) / 6, [f[2][2] for f in flat], t / length, 1 / length, [len(f[2][1]) / 20 for f in flat]], axis=1)
    return np.concatenate([np.stack([_path_vector(f[2][1]) for f in flat]), bag / np.maximum(1, counts)[:, None], measures], axis=1, dtype=np.float32)


def _flat(pages: list[list]) -> tuple[list[tuple], np.ndarray]:
    flat = [(t, p, b) for p, page in enumerate(pages) for t, b in enumerate(page)]
    return flat, np.array([len(page) for page in pages])[np.array([f[1] for f in flat], dtype=np.int64)]


def features(pages: list[list[tuple[str, tuple[str, ...], float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs ``(position, page, feature)`` and the mask of the positions that are blocks."""
    longest = max(map(len, pages), default=0)
    x, mask = np.zeros((longest, len(pages), INPUTS), dtype=np.float32), np.zeros((longest, len(pages), 1), dtype=np.float32)
    flat, length = _flat(pages)
    if flat:
        t, p = np.array([f[0] for f in flat]), np.array([f[1] for f in flat])
        x[t, p], mask[t, p] = _vectors(flat, length), 1
    return x, mask


def groups(sizes: list[int], most: int) -> list[list[int]]:
    """Pages by number of blocks, in groups that take up to ``most`` positions once padded; a longer page goes alone."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if out and (len(out[-1]) + 1) * sizes[i] <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """The net: an LSTM each way and a logistic output on both states."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in ("f", "b"):
            self.w[f"{d}x"] = (rng.standard_normal((INPUTS, 4 * HIDDEN)) * INPUTS**-0.5).astype(np.float32)
            self.w[f"{d}h"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * HIDDEN**-0.5).astype(np.float32)
            self.w[f"{d}c"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        self.w["o"] = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32)
        self.w["oc"] = np.zeros(1, dtype=np.float32)

    def _pass(self, d: str, z_all: np.ndarray, mask: np.ndarray, keep: bool):
        """One way over the sequences, from the inputs' share in the gates: the states, and what the gradient needs."""
        order = range(len(z_all)) if d == "f" else range(len(z_all) - 1, -1, -1)
        h = np.zeros((z_all.shape[1], HIDDEN), dtype=np.float32)
        c, states, trace = h, np.zeros((*z_all.shape[:2], HIDDEN), dtype=np.float32), []
        for t in order:
            z = z_all[t] + h @ self.w[f"{d}h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            m = mask[t]
            if keep:
                trace.append((t, i, f, o, g, c, h, tanh_c))
            c, h = m * new_c + (1 - m) * c, m * (o * tanh_c) + (1 - m) * h
            states[t] = h
        return states, trace

    def _gates(self, d: str, x: np.ndarray) -> np.ndarray:
        return x @ self.w[f"{d}x"] + self.w[f"{d}c"]

    def probabilities(self, pages: list[list]) -> np.ndarray:
        """``(position, page)``: how likely each block is article. Blocks become vectors some at a time; only their gates are kept."""
        longest = max(map(len, pages), default=0)
        z = {d: np.zeros((longest, len(pages), 4 * HIDDEN), dtype=np.float32) for d in ("f", "b")}
        mask = np.zeros((longest, len(pages), 1), dtype=np.float32)
        flat, length = _flat(pages)
        for at in range(0, len(flat), POSITIONS):
            some = flat[at : at + POSITIONS]
            x, t, p = _vectors(some, length[at : at + POSITIONS]), np.array([f[0] for f in some]), np.array([f[1] for f in some])
            mask[t, p] = 1
            for d in z:
                z[d][t, p] = self._gates(d, x)
        both = np.concatenate([self._pass(d, z[d], mask, False)[0] for d in ("f", "b")], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["oc"])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        ways = {d: self._pass(d, self._gates(d, x), mask, True) for d in ("f", "b")}
        both = np.concatenate([ways["f"][0], ways["b"][0]], axis=2)
        error = (_sigmoid(both @ self.w["o"] + self.w["oc"]) - y) * mask[..., 0] / mask.sum()
        out = {"o": (both * error[..., None]).sum((0, 1)), "oc": error.sum(keepdims=True)[0]}
        for k, d in enumerate(("f", "b")):
            up = error[..., None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            wh, dwh = self.w[f"{d}h"], np.zeros_like(self.w[f"{d}h"])
            dh, dc = np.zeros_like(up[0]), np.zeros_like(up[0])
            for t, i, f, o, g, c_before, h_before, tanh_c in reversed(ways[d][1]):
                m = mask[t]
                dh = dh + up[t]
                own_h, own_c = dh * m, dc * m
                own_c = own_c + own_h * o * (1 - tanh_c**2)
                dz = np.concatenate([own_c * g * i * (1 - i), own_c * c_before * f * (1 - f), own_h * tanh_c * o * (1 - o), own_c * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                dwh += h_before.T @ dz
                dh, dc = dz @ wh.T + dh * (1 - m), own_c * f + dc * (1 - m)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            out |= {f"{d}x": x.reshape(-1, INPUTS).T @ flat, f"{d}h": dwh, f"{d}c": flat.sum(0)}
        return out

    def fit(self, pages: list, labels: list[list[int]], epochs: int, seed: int = 5, rate: float = 0.01) -> Labeller:
        rng = np.random.default_rng(seed)
        first, second, step = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2)), None, 0
        first, second = first
        for epoch in range(epochs):
            for some in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // 24)):
                x, mask = features([pages[i] for i in some])
                y = np.zeros(mask.shape[:2], dtype=np.float32)
                for k, i in enumerate(some):
                    y[: len(labels[i]), k] = labels[i]
                step += 1
                for name, g in self.gradient(x, mask, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.w[name] = (self.w[name] - rate * (0.85**epoch) * move).astype(np.float32)
        return self


# Names that pages give to parts around the article, and to the article.
BOILERPLATE = {
    "menu": ("nav", "ul", "c:menu c:nav c:navbar c:navigation c:breadcrumb i:menu r:navigation c:topbar c:tabs c:links"),
    "header": ("header", "div", "c:header c:masthead c:banner i:header r:banner c:logo c:site"),
    "footer": ("footer", "div", "c:footer i:footer c:copyright c:legal c:bottom r:contentinfo c:colophon"),
    "sidebar": ("aside", "div", "c:sidebar i:sidebar c:widget c:related c:recommended c:popular c:trending r:complementary c:rail"),
    "notice": ("div", "section", "c:cookie c:notice c:consent c:banner c:alert c:popup c:modal i:gdpr r:alert c:disclaimer c:newsletter c:subscribe"),
    "advert": ("div", "ins", "c:ad c:ads c:advert c:advertisement c:sponsored c:promo c:sponsor i:ad c:adsense c:banner"),
    "form": ("form", "form", "c:form c:login c:search c:signup i:search r:search r:form"),
    "comments": ("section", "div", "c:comments c:comment i:comments c:replies c:discussion c:disqus c:responses"),
    "share": ("div", "ul", "c:share c:social c:sharing c:buttons c:follow c:tags"),
}
CONTENT = "c:content c:article c:post c:entry c:story c:text c:main c:body i:content i:main r:main c:page c:wrapper c:container"
SAYINGS = {
    "menu": "home about contact news products services login archive blog help".split(),
    "header": "welcome to our site search menu login".split(),
    "footer": "© copyright all rights reserved privacy terms contact imprint ·".split(),
    "sidebar": "related popular recent posts tags categories archives more".split(),
    "notice": "we use cookies accept continue subscribe newsletter notice privacy".split(),
    "advert": "advertisement sponsored buy now offer sale click here".split(),
    "form": "name email password submit send search subscribe".split(),
    "comments": "reply says said comment posted ago like report thanks great".split(),
    "share": "share tweet facebook email print follow us".split(),
}


SYLLABLES = "ba to ri en sul ka mo th er qu is lé or an du ße ción we zi po".split()
MADE_WORDS = [a + b for a in ["", *SYLLABLES] for b in SYLLABLES]


def make_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """One page in a random layout, and for each of its blocks whether it is article."""
    html, labels = [], []

    def words(n, own=()):
        out = [MADE_WORDS[i] for i in rng.integers(0, len(MADE_WORDS), n)]
        for w in own:
            if rng.random() < 0.3:
                out.insert(int(rng.integers(0, len(out) + 1)), w)
        return " ".join(out) or "x"

    def attributes(names, least=0):
        if least == 0 and rng.random() < 0.4:
            return ""
        kind, _, value = rng.choice(names.split()).partition(":")
        extra = rng.choice(["", "", " box", " col-6", " wrap", "-inner", "-1", " clearfix"])
        return f' {dict(c="class", i="id", r="role")[kind]}="{value}{extra if kind == "c" else ""}"'

    def put(tag, text, label, inner="{}"):
        html.append(f"<{tag}>{inner.format(text)}" + (f"</{tag}>" if rng.random() < 0.93 or tag != "p" else ""))
        labels.append(label)

    def part(kind):
        proper, plain, names = BOILERPLATE[kind]
        tag = proper if rng.random() < 0.55 else plain
        named = attributes(names, 1 if tag in ("div", "ul", "section", "ins") else 0)
        html.append(f"<{tag}{named}>")
        shape = rng.random()
        if kind in ("menu", "share") or (kind in ("sidebar", "footer") and shape < 0.5):
            html.append("<ul>" if tag != "ul" else "")
            for _ in range(rng.integers(2, 10)):
                put("li", words(rng.integers(1, 4), SAYINGS[kind][:2]), 0, '<a href="/x">{}</a>')
            html.append("</ul>" if tag != "ul" else "")
        elif kind == "form":
            for _ in range(rng.integers(1, 4)):
                put(rng.choice(["p", "div", "legend"]), words(rng.integers(1, 6), SAYINGS[kind]), 0, "<label>{}</label><input name=q>")
        elif kind == "comments":
            put("h3", words(2, ["comments"]), 0)
            for _ in range(rng.integers(1, 5)):
                put(rng.choice(["p", "div", "li"]), words(rng.integers(3, 60), SAYINGS[kind]), 0)
        elif shape < 0.6:
            html.append(words(rng.integers(2, 25), SAYINGS[kind]))
            labels.append(0)
        else:
            for _ in range(rng.integers(1, 4)):
                put(rng.choice(["p", "div", "span", "h4"] if tag != "ins" else ["p", "div"]), words(rng.integers(1, 30), SAYINGS[kind]), 0)
                if html[-1].startswith("<span"):  # an inline tag makes no block of its own
                    html[-1] = html[-1].replace("<span>", "<div>").replace("</span>", "</div>")
        html.append(f"</{tag}>")

    def article():
        put(rng.choice(["h1", "h1", "h2"]), words(rng.integers(2, 12)), 1)
        for _ in range(int(rng.choice([3, 8, 16, 40]) * rng.uniform(0.3, 1.0)) + 1):
            r = rng.random()
            if r < 0.75:
                put("p", words(int(rng.choice([2, 5, 15, 40, 90]) * rng.uniform(0.6, 1.4)) + 1), 1, rng.choice(["{}", "{}", "{}", "<b>{}<br>", '<a href="/y">w</a> {}', "<em>{}</em> a"]))
            elif r < 0.82:
                put(rng.choice(["h2", "h3"]), words(rng.integers(1, 6)), 1)
            elif r < 0.88:
                put(rng.choice(["blockquote", "pre", "figcaption"]), words(rng.integers(3, 30)), 1)
            elif r < 0.94:
                html.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    put("li", words(rng.integers(1, 20)), 1)
                html.append("</ul>")
            else:
                html.append("<table><tr>")
                for _ in range(rng.integers(1, 4)):
                    put("td", words(rng.integers(1, 6)), 1)
                html.append("</tr></table>")
            if rng.random() < 0.03:
                html.append("</p>")
                part(str(rng.choice(["advert", "share", "sidebar", "form", "notice"])))
        if rng.random() < 0.1:
            part("comments")

    before = [k for k in ("notice", "header", "menu", "form", "advert", "sidebar") if rng.random() < 0.5]
    after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if rng.random() < 0.45]
    wrap = rng.choice(["", "<div id=page>", '<div class="wrapper">', '<div class="container"><div class="row">'])
    html.append(f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{wrap}")
    for k in before:
        part(k)
    kind = rng.random()
    tag = "article" if kind < 0.6 else "main" if kind < 0.75 else "div" if kind < 0.93 else "section"
    html.append(f"<{tag}{attributes(CONTENT, 1 if tag in ('div', 'section') else 0)}>")
    article()
    html.append(f"</{tag}>")
    for k in after:
        part(k)
    if rng.random() < 0.9:
        html.append("</body></html>")
    return "".join(html), labels


def training_set(n: int, seed: int = 17) -> tuple[list, list[list[int]]]:
    """``n`` made pages as blocks, with their labels."""
    rng, pages, labels = np.random.default_rng(seed), [], []
    while len(pages) < n:
        html, own = make_page(rng)
        found = blocks(html)
        if len(found) == len(own):  # a word run that the parser joins or drops would shift the labels
            pages.append(found)
            labels.append(own)
    return pages, labels


@cache
def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller fitted on made pages; the same one every time, so a process trains it once."""
    return Labeller().fit(*training_set(pages), epochs)


def main_text(html: Column, spark: SparkSession, model: Labeller | None = None) -> Column:
    """The main text of each page: its article blocks in page order, joined by two newlines.

    Reads the whole page; null, empty or blank html, and pages without article, give an empty text. Each
    row is read by itself, so repeated pages give the same text again. Memory follows the longest page:
    its blocks, and a few hundred bytes for each.
    """
    held = spark.sparkContext.broadcast(model or train())

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = held.value
        for column in batches:
            out: list[str] = []
            for first in range(0, len(column), PAGES_AT_ONCE):
                pages = [blocks(v.as_py()) for v in column.slice(first, PAGES_AT_ONCE)]
                texts = [""] * len(pages)
                for some in groups(list(map(len, pages)), POSITIONS):
                    p = net.probabilities([pages[i] for i in some])
                    for k, i in enumerate(some):
                        texts[i] = "\n\n".join(b[0] for b, x in zip(pages[i], p[:, k]) if x >= 0.5)
                out += texts
            yield pa.array(out, pa.string())
            give_back()

    return extract(html)
