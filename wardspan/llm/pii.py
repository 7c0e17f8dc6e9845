"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained from a small labelled table: runs of words with digits or `@` from a bounded sample of documents,
labelled by the base patterns, and variants of phone numbers without their plus sign. Words without a digit or `@`
can only be outside; so a text falls into short independent runs, which are decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.tables import distinct_texts, map_batches, map_tasks, picked

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SAMPLE_DOCS = 4_000
TRAIN_WORDS = 12
MOST_RUNS = 3_000
#: Scores of longer words are not kept.
MOST_CACHED_CHARS = 200

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TRIGGER = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @ in linear time."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(twice[int(d)]) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start and then kind; failing matches are dropped."""
    found = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text)]
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match[0].split(".")):
            found.append((*match.span(), 1))
    for match in CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*match.span(), 2))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in match[0]) <= 15:
                found.append((*match.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of consecutive words that hold a digit or `@`, as word spans."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    hit = TRIGGER.search(text)
    while hit:
        start = hit.start()
        while start > max(end, 0) and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        word = WORD.match(text, start)
        if end >= 0 and not WORD.search(text, end, start):
            out[-1].append(word.span())
        else:
            out.append([word.span()])
        end = word.end()
        hit = TRIGGER.search(text, end)
    return out


def shape(word: str) -> str:
    word = DIGITS.sub(lambda m: f"9{len(m[0])}" if len(m[0]) < 5 else "9+", word)
    return LETTERS.sub("a", word)


def features(word: str) -> list[str]:
    core = word.strip("#*$%&!?.,;:\"'|<>")
    digits = sum(map(word.count, "0123456789"))
    return ["bias", "w=" + shape(word), "c=" + shape(core), f"d={min(digits, 20)}", f"@={'@' in word}", f"+={core[:1] == '+'}", f"dots={min(core.count('.'), 4)}", f"a={any(c.isalpha() for c in core)}"]


@dataclass
class Field:
    """Weights of the field; unknown features weigh nothing, runs begin and end next to O."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def scores(self, word: str) -> np.ndarray:
        return self.emit[[self.index[f] for f in features(word) if f in self.index]].sum(axis=0)

    def decode(self, sequences: list[list[np.ndarray]], most: int = 100_000) -> list[np.ndarray]:
        """Best labels of every sequence of word scores; sequences of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            last = at + 1
            while last < len(order) and (last - at + 1) * len(sequences[order[last]]) <= most:
                last += 1
            part = order[at:last]
            for k, labels in zip(part, viterbi([sequences[p] for p in part], self.step), strict=True):
                out[k] = labels
            at = last
        return out


def viterbi(sequences: list[list[np.ndarray]], step: np.ndarray) -> list[np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    n, longest = len(sequences), int(lengths.max())
    scores = np.zeros((longest, n, len(LABELS)))
    for k, s in enumerate(sequences):
        scores[: len(s), k] = s
    best = step[0] + scores[0]
    back = np.zeros((longest, n, len(LABELS)), np.int8)
    final = np.zeros(n, np.int64)
    for t in range(longest):
        if t:
            reach = best[:, :, None] + step
            back[t] = reach.argmax(axis=1)
            best = reach.max(axis=1) + scores[t]
        ending = lengths == t + 1
        final[ending] = (best[ending] + step[:, 0]).argmax(axis=1)
    labels = np.zeros((longest, n), np.int64)
    current = final.copy()
    for t in range(longest - 1, -1, -1):
        inside = lengths > t
        labels[t, inside] = current[inside]
        current[inside] = back[t, np.flatnonzero(inside), current[inside]]
    return [labels[: lengths[k], k] for k in range(n)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.15, shrink: float = 1e-3) -> Field:
    """Fit the field to labelled runs (words, labels) by Adam on the penalised log-likelihood."""
    weights: dict[tuple, int] = {}
    for words, labels in table:
        key = tuple(tuple(features(w)) for w in words), tuple(labels)
        weights[key] = weights.get(key, 0) + 1
    index: dict[str, int] = {}
    for words, _ in weights:
        for fs in words:
            for f in fs:
                index.setdefault(f, len(index))
    size, n = len(LABELS), len(weights)
    params = [np.zeros((len(index), size)), np.zeros((size, size))]
    if not n:
        params[1][0, 1:] = -1.0
        return Field(index, params[0], params[1])
    length = np.array([len(w) for w, _ in weights])
    longest, wide = int(length.max()), len(features("1"))
    ids = np.zeros((longest, n, wide), np.int64)
    gold = np.zeros((longest, n), np.int64)
    for k, (words, labels) in enumerate(weights):
        gold[: len(labels), k] = labels
        for t, fs in enumerate(words):
            ids[t, k] = [index[f] for f in fs]
    weight = np.array(list(weights.values()), float)
    weight /= weight.sum()
    inside = np.arange(longest)[:, None] < length[None]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for turn in range(1, rounds + 1):
        emit, step = params
        scores = emit[ids].sum(axis=2)
        alpha = np.zeros((longest, n, size))
        alpha[0] = step[0] + scores[0]
        for t in range(1, longest):
            alpha[t] = np.where(inside[t][:, None], _log_sum(alpha[t - 1][:, :, None] + step, 1) + scores[t], alpha[t - 1])
        total = _log_sum(alpha[-1] + step[:, 0], 1)
        beta = np.tile(step[:, 0], (longest, n, 1))
        slope = [np.zeros_like(emit), np.zeros_like(step)]
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                onward = _log_sum(step + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(inside[t + 1][:, None], onward, beta[t])
            marginal = np.exp(alpha[t] + beta[t] - total[:, None]) * inside[t][:, None]
            marginal[np.arange(n), gold[t]] -= inside[t]
            marginal *= weight[:, None]
            for f in range(wide):
                np.add.at(slope[0], ids[t, :, f], marginal)
            last = inside[t] & ((t + 1 == longest) | ~inside[min(t + 1, longest - 1)])
            slope[1][:, 0] += marginal[last].sum(axis=0)
            if not t:
                slope[1][0] += marginal.sum(axis=0)
            else:
                both = np.exp(alpha[t - 1][:, :, None] + step + (scores[t] + beta[t])[:, None, :] - total[:, None, None])
                both *= (inside[t] * weight)[:, None, None]
                slope[1] += both.sum(axis=0)
                np.add.at(slope[1], (gold[t - 1][inside[t]], gold[t][inside[t]]), -weight[inside[t]])
        for k, p in enumerate(params):
            g = slope[k] + shrink * p
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-8)
    return Field(index, params[0], params[1])


def labelled_run(text: str, words: list[tuple[int, int]], spans: list[Span]) -> tuple[list[str], list[int]]:
    labels = []
    for a, b in words:
        over = [s for s in spans if s[0] < b and s[1] > a]
        labels.append(0 if not over else 1 + 2 * over[0][2] + (over[0][0] < a))
    return [text[a:b] for a, b in words], labels


def training_table(docs: DataFrame, sample_docs: int, most_runs: int) -> list[tuple[list[str], list[int]]]:
    """Labelled runs of a sample of the documents that hold digits or `@`, in a fixed order, and their variants."""
    holding = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    order = F.xxhash64(F.lit(3), "text")
    sample = holding.where(picked(order, distinct_texts(holding, order), sample_docs)).distinct()

    def label(batch):
        found = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            found += [labelled_run(text, words[k : k + TRAIN_WORDS], spans) for words in runs(text) for k in range(0, len(words), TRAIN_WORDS)]
        yield {"words": [w for w, _ in found], "labels": [y for _, y in found]}

    rows = map_batches(sample, label, "words array<string>, labels array<int>").distinct()
    taken = rows.orderBy(F.xxhash64("words"), "words", "labels").limit(most_runs).collect()
    table = [(list(row["words"]), list(row["labels"])) for row in taken]
    phone = LABELS.index("B-phone")
    bare = [([w.lstrip("+") if y == phone else w for w, y in zip(words, labels, strict=True)], labels) for words, labels in table if phone in labels]
    return table + [(words, labels) for words, labels in bare if all(TRIGGER.search(w) for w in words)]


def added_spans(text: str, words: list[tuple[int, int]], labels: np.ndarray, base: list[Span]) -> list[Span]:
    """The labelled words as spans, without symbols at their ends, where no base span lies."""
    out, k = [], 0
    while k < len(labels):
        if not labels[k]:
            k += 1
            continue
        kind, last = (labels[k] - 1) // 2, k
        while last + 1 < len(labels) and labels[last + 1] == 2 * kind + 2:
            last += 1
        start, end = words[k][0], words[last][1]
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        if start < end and not any(a < end and b > start for a, b, _ in base):
            out.append((start, end, int(kind)))
        k = last + 1
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind in spans)


def find_personal_data(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_runs: int = MOST_RUNS) -> DataFrame:
    """Personal data of every row: doc_id, n_email, n_ip, n_card, n_phone (base patterns), base_spans, spans, n_added.

    Needs doc_id and text, ignores other columns. Spans are written kind:start:end in code points, end exclusive, by start
    and then kind, joined by commas; `spans` also holds what the field adds outside the base spans. Null and empty texts
    hold none (empty strings). Without labelled runs the field adds nothing. Repeated rows are searched each; an empty
    table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    field = docs.sparkSession.sparkContext.broadcast(train(training_table(docs, sample_docs, most_runs)))

    def work(batches):
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base: list[list[Span]] = [[] for _ in texts]
            jobs, words_of, scores = [], [], []
            for k, text in enumerate(texts):
                if not text or not TRIGGER.search(text):
                    continue
                base[k] = base_spans(text)
                for words in runs(text):
                    row = []
                    for a, b in words:
                        word = text[a:b]
                        if len(word) > MOST_CACHED_CHARS:
                            row.append(field.value.scores(word))
                            continue
                        if word not in known:
                            if len(known) > 50_000:
                                known.clear()
                            known[word] = field.value.scores(word)
                        row.append(known[word])
                    jobs.append(k)
                    words_of.append(words)
                    scores.append(row)
            more: dict[int, list[Span]] = {}
            for k, words, labels in zip(jobs, words_of, field.value.decode(scores), strict=True):
                if labels.any():
                    more.setdefault(k, []).extend(added_spans(texts[k], words, labels, base[k]))
            whole = [sorted([*base[k], *more.get(k, [])], key=lambda s: (s[0], s[2], s[1])) for k in range(len(texts))]
            yield {
                "doc_id": batch.column("doc_id"),
                **{f"n_{kind}": [sum(s[2] == n for s in spans) for spans in base] for n, kind in enumerate(KINDS)},
                "base_spans": [written(spans) for spans in base],
                "spans": [written(spans) for spans in whole],
                "n_added": [len(more.get(k, [])) for k in range(len(texts))],
            }

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return map_tasks(docs, work, f"doc_id long, {counts}, base_spans string, spans string, n_added long")

