"""HTML main-text extraction with a linear-chain conditional random field.

A page is cut into DOM leaf blocks (``html_blocks``). Each block has features
of its ancestors (tags, class and id parts, the innermost telling one) and of
its text (length, share of linked text, punctuation, place on the page). A
two-label chain (boilerplate, main) is trained on labelled pages
(``html_training``) by maximum likelihood, and each page is decoded by Viterbi.

Scale: one narrow pass; pages never meet. The model is a dictionary of feature
weights whose size is set by the number of training pages (a parameter). Only
one page is in a task's Python memory besides the Arrow batch.

Defined results: a null or empty html gives the empty text; markup without a
closing tag is read as browsers roughly do; repeated rows stay; null ids and
urls stay null; an empty table gives an empty result; other columns are kept
by ``extract``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import ship_package
from furrow.llm.html_blocks import Block, leaf_blocks
from furrow.llm.html_training import labelled_pages
from furrow.llm.toxicity import minimise
from furrow.sources.tables import load

TRAINING_PAGES = 700
TRAINING_SEED = 5
ITERATIONS = 80
L2 = 0.3
# Parts of names and tags that tell what an element holds.
AWAY = set("""nav menu navigation header footer masthead sidebar aside cookie cookies notice banner ad ads advert adverts
advertisement sponsor sponsored promo promotion form subscribe newsletter signup login search comment comments commentlist
reply replies respond responses discussion disqus share sharing social related recommended recommendation breadcrumb
breadcrumbs pagination pager widget modal popup dialog alert gdpr consent copyright legal disclaimer tags button label
select option dialog noscript topbar toolbar secondary complementary navigation contentinfo reader feedback teaser
title head fieldset textarea input print skip hidden rss feed menubar""".split())
TOWARDS = set("article main content post entry story body text paragraph hentry single prose document".split())
WORDS = {"cookie": "cookie", "cookies": "cookie", "privacy": "cookie", "consent": "cookie", "subscribe": "call",
         "newsletter": "call", "sign": "call", "login": "call", "advertisement": "ad", "sponsored": "ad",
         "copyright": "rights", "reserved": "rights", "©": "rights", "reply": "reply", "comments": "reply",
         "share": "call", "related": "related"}


class PathState:
    """What the features of a path need of it, each from the parent's state.
    ``parts`` are the tags and names on the way (those that ``keep`` holds, if
    given); a state shares them with its parent unless its element adds some."""

    __slots__ = ("parts", "last", "hint", "depth", "inside", "away", "towards")

    def __init__(self, node, above, keep):
        tag, root = node.tag, node.tag in ("html", "body")
        self.parts = above.parts if above else frozenset()
        self.last = None if root else f"last:{tag}"
        # elements from here to the one that gives the hint, or to the outermost
        self.inside = min(above.inside + 1, 3) if above and above.inside >= 0 else -1 if root else 0
        self.hint, self.depth = (above.hint, min(above.depth + 1, 3)) if above else ("none", 0)
        keys = {tag, *node.names}
        if not root:
            own = {f"t:{tag}", *(f"c:{n}" for n in node.names)}
            own = {f for f in own if (keep is None or f in keep) and f not in self.parts}
            if own:
                self.parts = self.parts | own
            if keys & AWAY:
                self.hint, self.depth = "away", 0
            elif keys & TOWARDS:
                self.hint, self.depth = "towards", 0
        self.away = bool(keys & AWAY) or bool(above and above.away)
        self.towards = bool(keys & TOWARDS) or bool(above and above.towards)

    def rest(self) -> tuple:
        """Features besides ``parts``."""
        depth = self.depth if self.hint != "none" else max(self.inside, 0)
        out = (f"hint:{self.hint}", f"hint:{self.hint}:{depth}", f"away:{self.away}", f"towards:{self.towards}")
        return (self.last, *out) if self.last else out


OUTSIDE = ("hint:none", "hint:none:0", "away:False", "towards:False")


def path_states(blocks: list[Block], keep=None) -> list[PathState | None]:
    """The state of each block's innermost element; each element's once."""
    known: dict = {}
    for b in blocks:
        way, node = [], b.node
        while node is not None and node not in known:
            way.append(node)
            node = node.parent
        for node in reversed(way):
            known[node] = PathState(node, known.get(node.parent), keep)
    return [known.get(b.node) for b in blocks]


def text_key(block: Block, i: int, n: int) -> tuple:
    """What the features of a block's own text depend on."""
    t = block.text
    size = len(t)
    linked = block.linked / size
    a = 0 if size < 20 else 1 if size < 60 else 2 if size < 200 else 3
    b = 0 if linked < 0.05 else 1 if linked < 0.5 else 2
    kinds = ()
    if size < 400:
        kinds = tuple(sorted({k for w in set(t.lower().split()) if (k := WORDS.get(w.strip(".,:;!")))}))
    return a, b, t[-1] in ".!?…:;", min(t.count(","), 2), 4 * i // n, i == 0, i == n - 1, kinds


def text_features(key: tuple) -> list[str]:
    a, b, end, commas, place, first, final, kinds = key
    return ["one", f"size:{a}", f"linked:{b}", f"size:{a}:linked:{b}", f"end:{end}", f"commas:{commas}", f"place:{place}",
            f"first:{first}", f"final:{final}", *(f"w:{k}" for k in kinds)]


def features(blocks: list[Block]) -> list[list[str]]:
    n = len(blocks)
    return [[*(sorted(state.parts) if state else ()), *(state.rest() if state else OUTSIDE), *text_features(text_key(b, i, n))]
            for i, (b, state) in enumerate(zip(blocks, path_states(blocks)))]


def emissions(blocks: list[Block], weights: dict[str, float]) -> list[float]:
    """What the features of each block add up to. Only features with a weight
    are kept along a path, so long paths do not make long feature sets."""
    n, sums, out = len(blocks), {}, []

    def total(key, found) -> float:
        if key not in sums:
            sums[key] = sum(weights.get(f, 0.0) for f in found())
        return sums[key]

    states = path_states(blocks, weights)
    for i, (b, state) in enumerate(zip(blocks, states)):
        key = text_key(b, i, n)
        e = total(key, lambda: text_features(key))
        if state is None:
            e += total("outside", lambda: OUTSIDE)
        else:
            e += total(id(state.parts), lambda: sorted(state.parts))
            e += total((state.last, state.hint, state.depth, state.inside, state.away, state.towards), state.rest)
        out.append(e)
    return out


def _chain_objective(index, page, place, labels, width, pages, longest):
    """Negative log likelihood of all training chains and its gradient; chains
    run side by side, padded to the longest."""
    real = np.zeros((pages, longest), dtype=bool)
    real[page, place] = True
    y = np.zeros((pages, longest), dtype=np.int64)
    y[page, place] = labels
    last = real.sum(axis=1) - 1
    rows = np.arange(pages)
    block_of = np.repeat(np.arange(len(index)), [len(x) for x in index])
    flat = np.concatenate(index)

    def objective(x):
        w, trans = x[:width], x[width:width + 4].reshape(2, 2)
        e1 = np.bincount(block_of, weights=w[flat], minlength=len(index))
        emit = np.zeros((pages, longest, 2))
        emit[page, place, 1] = e1
        alpha = np.zeros((pages, longest, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            a = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1]) + emit[:, t]
            alpha[:, t] = np.where(real[:, t, None], a, alpha[:, t - 1])
        log_z = np.logaddexp(alpha[rows, last, 0], alpha[rows, last, 1])
        beta = np.zeros((pages, longest, 2))
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            follow = emit[:, t + 1] + beta[:, t + 1]
            b = np.logaddexp(trans[:, 0] + follow[:, :1], trans[:, 1] + follow[:, 1:])
            on = real[:, t + 1]
            beta[:, t] = np.where(on[:, None], b, 0.0)
            joint = np.exp(alpha[:, t, :, None] + trans + follow[:, None, :] - log_z[:, None, None])
            expected += joint[on].sum(axis=0)
        p1 = np.exp(alpha[page, place, 1] + beta[page, place, 1] - log_z[page])
        pair = real[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        gold = (emit[page, place, 1] * labels).sum() + (trans * seen).sum()
        loss = log_z.sum() - gold + 0.5 * L2 * (x @ x)
        gw = np.bincount(flat, weights=(p1 - labels)[block_of], minlength=width)
        return loss, np.concatenate([gw, (expected - seen).ravel()]) + L2 * x

    return objective


@lru_cache(maxsize=4)
def train(count: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> tuple[dict[str, float], tuple[float, ...]]:
    """Fit the chain on ``count`` labelled pages -> (feature weights towards
    main text, the four transition weights)."""
    return fit([(leaf_blocks(source), labels) for source, labels in labelled_pages(count, seed)])


def fit(pages: list[tuple[list[Block], dict[str, int]]]):
    ids: dict[str, int] = {}
    index, page, place, y = [], [], [], []
    for k, (blocks, labels) in enumerate(pages):
        for i, (b, f) in enumerate(zip(blocks, features(blocks))):
            index.append(np.array([ids.setdefault(x, len(ids)) for x in f], dtype=np.int64))
            page.append(k)
            place.append(i)
            y.append(labels.get(b.text, 0))
    fun = _chain_objective(index, np.array(page), np.array(place), np.array(y, dtype=np.int64), len(ids),
                           len(pages), max(place) + 1)
    x = minimise(fun, np.zeros(len(ids) + 4), ITERATIONS)
    return {f: float(x[i]) for f, i in ids.items()}, tuple(float(v) for v in x[len(ids):])


def decode(blocks: list[Block], model) -> list[int]:
    """Viterbi: the most likely labels of a page's blocks."""
    weights, (t00, t01, t10, t11) = model
    a = b = 0.0
    back = []
    for i, e in enumerate(emissions(blocks, weights)):
        if i == 0:
            a, b = 0.0, e
            continue
        from0, from1 = a + t01 > b + t11, a + t00 > b + t10
        back.append((0 if from1 else 1, 0 if from0 else 1))
        a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
    if not blocks:
        return []
    labels = [1 if b > a else 0]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(source: str | None, model) -> str:
    blocks = leaf_blocks(source or "")
    return "\n".join(b.text for b, y in zip(blocks, decode(blocks, model)) if y)


def extract(pages: DataFrame, model=None) -> DataFrame:
    """``pages`` (``html`` among the columns) plus ``text``, in place of a
    column of that name."""
    pages = pages.drop("text")
    ship_package(pages.sparkSession)
    model = model or train()
    schema = pages.select("*", F.lit("").alias("text")).schema

    def run(batches):
        for b in batches:
            texts = [main_text(h, model) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return pages.mapInArrow(run, schema)


def op7_extract(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op7_extract": op7_extract}
