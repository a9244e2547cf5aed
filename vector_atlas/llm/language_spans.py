"""Language of texts and of the spans of mixed texts: script ranges, per-word scores, Viterbi.

A word is a run of letters of one script. The script narrows the candidates to the languages that use it;
the word's score for a language is the sum of the logarithms of the shares of its byte trigrams and of
the word itself (both hashed) among those of the language. Viterbi finds the labels of the words of a
document that are best together when every change of language costs ``switch``. Neighbouring words of
one label are a span; the language with the most letters is the document's.

Counts are taken over all given documents with a language and added up by Spark. The model has a fixed
size, ``features`` numbers a language, and is broadcast. Scores are whole numbers, so the best path does
not depend on how the words are cut into blocks: the path is found for blocks of words side by side,
for every label a block may be entered with, and then through the blocks of each document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vector_atlas.llm import textbuf
from vector_atlas.llm.tables import map_batches

#: Scripts and their main ranges of letters in Unicode (first, last code point).
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))),
    ("greek", ((0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x386, 0x386), (0x388, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F))),
    ("armenian", ((0x531, 0x556), (0x561, 0x587))),
    ("hebrew", ((0x5D0, 0x5F2),)),
    ("arabic", ((0x620, 0x65F), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC))),
    ("devanagari", ((0x900, 0x963), (0x971, 0x97F))),
    ("bengali", ((0x980, 0x9E3), (0x9F0, 0x9F1))),
    ("gurmukhi", ((0xA01, 0xA5E),)),
    ("gujarati", ((0xA81, 0xAE3),)),
    ("tamil", ((0xB82, 0xBD7),)),
    ("telugu", ((0xC00, 0xC63),)),
    ("kannada", ((0xC80, 0xCE3),)),
    ("malayalam", ((0xD00, 0xD63),)),
    ("sinhala", ((0xD80, 0xDF3),)),
    ("thai", ((0xE01, 0xE3A), (0xE40, 0xE4E))),
    ("lao", ((0xE81, 0xECD),)),
    ("tibetan", ((0xF40, 0xFBC),)),
    ("myanmar", ((0x1000, 0x103F), (0x1050, 0x108F))),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3))),
    ("ethiopic", ((0x1200, 0x135A),)),
    ("khmer", ((0x1780, 0x17D3),)),
    ("mongolian", ((0x1820, 0x1878),)),
    ("kana", ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D))),
    ("han", ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
)


@dataclass(frozen=True)
class LanguageConfig:
    features: int = 1 << 16  # hashed trigrams and words of a language
    smooth: float = 0.5
    switch: float = 12.0  # what a change of language costs, in natural logarithms
    script_share: float = 0.02  # a language uses the scripts that have this share of its words
    block: int = 128  # words whose path is found side by side
    piece: int = 1 << 19  # bytes of text scored at a time
    languages: int = 200  # more than this many languages are an error


SCALE = 256  # scores are logarithms in whole 256ths
NEVER = -(1 << 24)  # the score of a word for a language that does not use its script

_EDGES = sorted((a, b, s + 1) for s, (_, ranges) in enumerate(SCRIPTS) for a, b in ranges)
_FIRST = np.array([a for a, _, _ in _EDGES])
_LAST = np.array([b for _, b, _ in _EDGES])
_SCRIPT = np.array([s for _, _, s in _EDGES], dtype=np.int8)
_ASCII = np.zeros(128, np.int8)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = 1


def scripts_of(data: np.ndarray) -> np.ndarray:
    """The script of each byte's character: 0 for none, else 1 + its place in ``SCRIPTS``. Whole UTF-8."""
    out = _ASCII[data & 0x7F]
    high = data >= 0x80
    if not high.any():
        return out
    out[high] = 0
    for lead, length in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero((data >= lead) & (data < (0xE0, 0xF0, 0x100)[length - 2]))
        if not len(at):
            continue
        code = (data[at] & (0x7F >> length)).astype(np.int64)
        for j in range(1, length):
            code = (code << 6) | (data[at + j] & 0x3F)
        range_of = np.searchsorted(_FIRST, code, side="right") - 1
        script = np.where((range_of >= 0) & (code <= _LAST[range_of]), _SCRIPT[range_of], 0)
        for j in range(length):
            out[at + j] = script
    return out


class Tokens:
    """Words of a chunk: starts, ends, scripts, and word offsets of its rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        script = scripts_of(data)
        change = np.ones(n + 1, bool)
        change[1:n] = script[1:] != script[:-1]
        change[offs] = True
        cuts = np.flatnonzero(change)
        letters = script[cuts[:-1]] > 0 if n else np.zeros(0, bool)
        self.starts, self.ends = cuts[:-1][letters], cuts[1:][letters]
        self.scripts = script[self.starts]
        self.offs = np.searchsorted(self.starts, offs)
        low = data.copy()
        low[(data >= 0x41) & (data <= 0x5A)] += 32
        low[script == 0] = 0x20
        self.low = np.concatenate(([0x20], low, [0x20])).astype(np.uint32)

    def features(self, cfg: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features, word after word (its trigrams, then itself), and the first one of each word."""
        low, half = self.low, cfg.features // 2
        code = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(7)
        code = (code % np.uint32(half)).astype(np.int32)
        sizes = self.ends - self.starts
        firsts = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.empty(int(firsts[-1]), np.int32)
        is_word = np.zeros(len(out), bool)
        is_word[firsts[1:] - 1] = True
        inside = np.zeros(len(low) - 1, np.int8)
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, self.ends, -1)
        out[~is_word] = code[np.cumsum(inside[:-1]) > 0]
        if len(self.starts):
            wide = np.append(code.astype(np.uint32) * np.uint32(0x27D4EB2F) + np.uint32(1), np.uint32(0))
            word = np.add.reduceat(wide, np.stack((self.starts, self.ends), axis=1).ravel())[::2]
            word = (word ^ (word >> np.uint32(13))) * np.uint32(0x165667B1)
            out[is_word] = half + (word >> np.uint32(8)) % np.uint32(cfg.features - half)
        return out, firsts


def _letters() -> np.ndarray:
    """Bytes that pieces of long texts are not cut at: ASCII letters and everything from 0x80 on."""
    mask = np.zeros(256, bool)
    mask[0x41:0x5B] = mask[0x61:0x7B] = mask[0x80:] = True
    return mask


class Model:
    """Word scores and the languages of each script."""

    def __init__(self, names: list[str], counts: np.ndarray, script_counts: np.ndarray, cfg: LanguageConfig):
        self.names, self.cfg = names, cfg
        half = cfg.features // 2
        self.table = np.zeros((cfg.features, len(names)), np.int32)
        for part in (slice(0, half), slice(half, cfg.features)):
            own = counts[:, part].T.astype(np.float64)
            share = (own + cfg.smooth) / (own.sum(axis=0) + cfg.smooth * own.shape[0])
            self.table[part] = np.rint(np.log(share) * SCALE)
        words = script_counts.sum(axis=1)
        uses = script_counts >= np.maximum(1, cfg.script_share * words[:, None])
        # a script that no language uses leaves all of them
        self.forbidden = np.where(uses | ~uses.any(axis=0), 0, NEVER).T.astype(np.int64)
        self.usual = int(np.argmax(words)) if len(names) else 0
        self.usual_share = float(words[self.usual] / max(words.sum(), 1)) if len(names) else 0.0
        self.switch = int(round(cfg.switch * SCALE))

    def emissions(self, tokens: Tokens) -> np.ndarray:
        """Words x languages."""
        codes, firsts = tokens.features(self.cfg)
        if not len(tokens.starts):
            return np.zeros((0, len(self.names)), np.int64)
        return np.add.reduceat(self.table[codes], firsts[:-1], axis=0, dtype=np.int64) + self.forbidden[tokens.scripts - 1]

    @property
    def piece(self) -> int:
        """Bytes of text scored at a time: the fewer, the more languages."""
        return max(4096, 4 * self.cfg.piece // max(4, len(self.names)))


def _lanes(start: np.ndarray, length: np.ndarray):
    """Blocks by falling length, and how many of them are longer than each step."""
    order = np.argsort(-length, kind="stable")
    running = np.searchsorted(-length[order], -np.arange(int(length.max())), side="left")
    return order, start[order], running.tolist()


def _reach(scores: np.ndarray, start: np.ndarray, length: np.ndarray, switch: int) -> np.ndarray:
    """Blocks x label before x label at the end: the value of the best path through each block."""
    width = scores.shape[1]
    order, start, running = _lanes(start, length)
    reach = np.full((len(start), width, width), np.iinfo(np.int64).min // 4)
    reach[:, np.arange(width), np.arange(width)] = 0
    for t, r in enumerate(running):
        now = reach[:r]
        reach[:r] = np.maximum(now, now.max(axis=2, keepdims=True) - switch) + scores[start[:r] + t][:, None, :]
    out = np.empty_like(reach)
    out[order] = reach
    return out


def best_paths(scores: np.ndarray, offs: np.ndarray, switch: int, block: int) -> np.ndarray:
    """The label of each word on the best path of its document (words ``offs[d]`` to ``offs[d + 1]``); of
    equal paths one that changes its label earlier, to the smallest label."""
    n, width = scores.shape
    labels = np.zeros(n, np.int32)
    if n == 0 or width <= 1:
        return labels
    counts = np.diff(offs)
    per_doc = -(-counts // block)
    first_block = np.concatenate(([0], np.cumsum(per_doc)))
    total = int(first_block[-1])
    doc = np.repeat(np.arange(len(counts)), per_doc)
    start = offs[doc] + (np.arange(total) - first_block[doc]) * block
    length = np.minimum(block, offs[doc + 1] - start)
    # values of all labels before each block, through the blocks of a document one after the other
    enter = np.zeros((total, width), np.int64)
    group = max(1, (1 << 23) // (width * width))
    for lo in range(0, total, group):
        reach = _reach(scores, start[lo : lo + group], length[lo : lo + group], switch)
        for b in range(lo, min(lo + group, total - 1)):
            if doc[b + 1] == doc[b]:
                enter[b + 1] = (enter[b][:, None] + reach[b - lo]).max(axis=0)
    # forward through all blocks at once; ``came`` is the label before each word for every label at it
    order, start, running = _lanes(start, length)
    value = enter[order]
    came = np.zeros((len(running), total, width), np.int16 if width > 127 else np.int8)
    for t, r in enumerate(running):
        now = value[:r]
        top = now.argmax(axis=1)
        change = now[np.arange(r), top] - switch
        stay = now >= change[:, None]
        came[t, :r] = np.where(stay, np.arange(width), top[:, None])
        value[:r] = np.where(stay, now, change[:, None]) + scores[start[:r] + t]
    final, place = value.argmax(axis=1), np.argsort(order)
    before = np.tile(np.arange(width), (total, 1))  # the label before a block for every label at its end
    for t in range(len(running) - 1, -1, -1):
        r = running[t]
        before[:r] = np.take_along_axis(came[t, :r].astype(np.int64), before[:r], axis=1)
    label = np.zeros(total, np.int64)
    follows = 0
    for b in range(total - 1, -1, -1):
        lane = place[b]
        label[lane] = final[lane] if b + 1 == first_block[doc[b] + 1] else follows
        follows = int(before[lane, label[lane]])
    for t in range(len(running) - 1, -1, -1):
        r = running[t]
        labels[start[:r] + t] = label[:r]
        label[:r] = came[t, np.arange(r), label[:r]]
    return labels


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", cfg: LanguageConfig = LanguageConfig()) -> Model:
    """The model of all rows of ``docs`` that have a language. Its counts are added up by Spark; what
    reaches the driver is the model, at most ``features + len(SCRIPTS)`` numbers a language."""
    import pyarrow as pa

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().limit(cfg.languages + 1).collect())
    if len(names) > cfg.languages:
        raise ValueError(f"more than {cfg.languages} languages")
    place = {name: i for i, name in enumerate(names)}
    width = cfg.features + len(SCRIPTS)

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = [place[x] for x in batch.column(0).to_pylist()]
            for lo, data, offs in textbuf.pieces(batch.column(1), _letters(), cfg.piece):
                tokens = Tokens(data, offs)
                codes, firsts = tokens.features(cfg)
                own = np.array(langs[lo : lo + len(offs) - 1])
                word_lang = np.repeat(own, np.diff(tokens.offs))
                code_lang = np.repeat(word_lang, np.diff(firsts))
                for lang in np.unique(own).tolist():
                    row = total.setdefault(lang, np.zeros(width, np.int64))
                    row[: cfg.features] += np.bincount(codes[code_lang == lang], minlength=cfg.features)
                    row[cfg.features :] += np.bincount(tokens.scripts[word_lang == lang] - 1, minlength=len(SCRIPTS))
            if len(total) > 32:
                yield from rows(total)
                total = {}
        yield from rows(total)

    def rows(total):
        for lang, row in total.items():
            held = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), lang)), pa.array(held, pa.int64()), pa.array(row[held])], names=["lang", "feature", "n"])

    counts = np.zeros((len(names), width), np.int64)
    if names:
        found = known.mapInArrow(count, "lang bigint, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
        counts[found.column("lang").to_numpy(), found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return Model(names, counts[:, : cfg.features], counts[:, cfg.features :], cfg)


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, spans``; ``spans`` are ``start, end`` (code points) and ``lang`` of runs of words.

    ``lang_pred`` is the language with the most bytes of letters, of equals the smallest; ``score`` its
    share of them, times the chance that the whole text is of that language rather than of any other.
    Null, empty and letterless texts are ``und`` with score 0 and no spans; so is every text if the model
    knows no language. A text whose letters are all of scripts that are not listed gets the most frequent
    language, with the language's share of words as its score. Rows that repeat an id are labelled alike
    if their texts are; columns besides the id and the text are not read.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def documents(column, model):
        """Runs of rows: first row, word counts, starts and ends in code points, byte sizes, emissions."""
        held, shift = [], 0
        for lo, data, offs in textbuf.pieces(column, _letters(), model.piece):
            if held and held[0][0] != lo:
                yield joined(held)
                held, shift = [], 0
            tokens = Tokens(data, offs)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            counts = np.diff(tokens.offs)
            base = np.repeat(points[offs[:-1]], counts) - shift
            held.append([lo, counts, points[tokens.starts] - base, points[tokens.ends] - base, tokens.ends - tokens.starts, model.emissions(tokens)])
            shift += int(points[-1])
        if held:
            yield joined(held)

    def joined(parts):
        if len(parts) == 1:
            return parts[0]
        return [parts[0][0], sum(p[1] for p in parts), *(np.concatenate([p[c] for p in parts]) for c in range(2, 6))]

    def step(_, batch):
        model = shared.value
        letters = batch.column(2)
        width = len(model.names)
        for lo, counts, starts, ends, sizes, scores in documents(batch.column(1), model):
            rows = len(counts)
            offs = np.concatenate(([0], np.cumsum(counts)))
            preds, values, spans = [], [], []
            labels = best_paths(scores, offs, model.switch, model.cfg.block) if width else np.zeros(len(starts), np.int32)
            for d in range(rows):
                a, b = offs[d], offs[d + 1]
                if not width or not letters[lo + d].as_py():
                    preds.append("und")
                    values.append(0.0)
                    spans.append([])
                elif a == b:
                    preds.append(model.names[model.usual])
                    values.append(model.usual_share)
                    spans.append([])
                else:
                    own = labels[a:b]
                    weight = np.bincount(own, weights=sizes[a:b], minlength=width)
                    pred = int(weight.argmax())
                    total = scores[a:b].sum(axis=0) / SCALE
                    others = np.exp(np.minimum(total - total[pred], 700.0)).sum()
                    preds.append(model.names[pred])
                    values.append(float(weight[pred] / weight.sum() / max(1.0, others)) if width > 1 else 1.0)
                    cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [b - a]))
                    spans.append([
                        {"start": s, "end": e, "lang": model.names[x]}
                        for s, e, x in zip(starts[a + cuts[:-1]].tolist(), ends[a + cuts[1:] - 1].tolist(), own[cuts[:-1]].tolist())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, rows), pa.array(preds, pa.string()), pa.array(values, pa.float64()), pa.array(spans, pa.list_(span))],
                names=["id", "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return map_batches(rows, f"id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>", lambda: None, step)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
