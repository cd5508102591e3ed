"""Reading band of documents by smoothed unigram language models, one for each band.

The models are trained on labelled texts and refined by reassigning sentences
to their most likely band (labelled texts hold a few sentences of neighbouring
bands).  A document's sentences each go to the band of highest posterior
likelihood under equal priors; the document has the band of most of its
sentences, ties to the higher summed likelihood, then the lower band.

Only running English sentences count: pieces of text, cut at line ends and
sentence ends, in which most words are English by the models' vocabulary and
function words.  Headings, lists of tags, data, other languages and remarks are
no sentences.  Documents with fewer than ``min_words`` words of sentences have
no band and give no row; so do null and empty texts and, unless ``mixed``,
documents with more words in sentences of other languages than in English ones.  Repeated rows of a
document give one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwright.llm.forms import rewriter

# Common English function words.
FUNCTION_WORDS = frozenset(
    "a about above after again all although an and any are as at be because been before both but by can cannot could did do does each "
    "even ever every few for from had has have he her here hers him his how i if in into is it its may me might more most much must my "
    "never next no nobody nor not nothing now of off on one only or other our out over she should since so some still such than that the "
    "their them then there these they this those though through to too under until up us very was we were what when where whether which "
    "while who whose why will with without would yes yet you your".split()
)
WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+")
LEAD = re.compile(r"^(?:[\s>|*#•–-]+|\d{1,2}:\d{2}(?::\d{2})?\s+|\(?\d{1,3}[.)]\s+)+")
DATA = re.compile(r"[#\d:;|{}\[\]\t=]")
SENTENCE_END = re.compile(r"(?<=[.!?])[\"'”’)]*\s+(?=[\"'“(]?[A-Z0-9])")
# Full stops that end no sentence.
ABBREVIATIONS = ("vs.", "approx.", "e.g.", "i.e.", "etc.", "no.", "p.m.", "a.m.", "Mr.", "Mrs.", "Dr.")


def _goes_on(piece: str) -> bool:
    """Whether a piece ends with an abbreviation or an initial."""
    return piece.endswith(ABBREVIATIONS) or (piece[-2:-1].isupper() and piece[-1:] == "." and not piece[-3:-2].isalpha())


def pieces(text: str) -> list[str]:
    """A text cut at line ends and sentence ends, without mark-up and list marks.  A line that
    goes on in lower case after a letter or comma is one line with the next."""
    if "<" in text:
        text = TAG.sub("\n", text)
    if "://" in text or "www." in text:
        text = ADDRESS.sub(" ", text)
    lines: list[str] = []
    for line in text.splitlines():
        bare = line.lstrip(" \t|>")
        if bare[:1].islower() and lines and (lines[-1][-1].isalpha() or lines[-1][-1] in ",;"):
            lines[-1] += " " + bare.rstrip(" |")
            continue
        if line and not line[0].isalpha():
            line = LEAD.sub("", line)
        if line.strip():
            lines.append(line.rstrip(" |\t"))
    out: list[str] = []
    for line in lines:
        held = ""
        for piece in SENTENCE_END.split(line):
            held = f"{held} {piece}" if held else piece
            if not _goes_on(piece):
                out.append(held)
                held = ""
        if held:
            out.append(held)
    return out


class BandModels:
    """Add-alpha unigram models; log likelihood of words per band.

    Row 0 of the tables stands for words that no labelled text holds."""

    def __init__(self, bands: list[int], tables: list[Counter], alpha: float) -> None:
        self.bands = bands
        words = sorted({w for t in tables for w in t} | FUNCTION_WORDS)
        self.number = {w: k + 1 for k, w in enumerate(words)}
        counts = np.array([[0.0] + [t[w] for w in words] for t in tables]).T
        self.log = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * len(counts)))
        self.common = np.array([0] + [w in FUNCTION_WORDS for w in words], dtype=np.int64)

    def score(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihoods per band, words, whether English) of each sentence; none is empty."""
        number = self.number
        flat = np.array([number.get(w, 0) for words in sentences for w in words], dtype=np.int64)
        lengths = np.array([len(words) for words in sentences])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        known, common = np.add.reduceat((flat > 0).astype(np.int64), starts), np.add.reduceat(self.common[flat], starts)
        english = (lengths >= 3) & (common * 8 >= lengths) & (known * 2 >= lengths)
        return np.add.reduceat(self.log[flat], starts, axis=0), lengths, english


def words_of(piece: str) -> list[str]:
    return WORD.findall(piece.lower())


def train(samples: list[tuple[str, int]], alpha: float = 0.1, rounds: int = 3) -> BandModels:
    """Models from labelled texts.  Each round moves sentences to their most likely band."""
    sentences = [(words_of(p), band) for text, band in samples if isinstance(text, str) and band is not None for p in pieces(text)]
    sentences = [(w, b) for w, b in sentences if w]
    if not sentences:
        raise ValueError("no labelled text holds a word")
    bands = sorted({b for _, b in sentences})
    own = np.array([bands.index(b) for _, b in sentences])
    words, given, model = [w for w, _ in sentences], own, None
    for _ in range(rounds + 1):
        tables: list[Counter] = [Counter() for _ in bands]
        for one, band in zip(words, given, strict=True):
            tables[band].update(one)
        model = BandModels(bands, tables, alpha)
        scores, lengths, _ = model.score(words)
        given = np.where(lengths >= 3, scores.argmax(axis=1), own)
    return model


def grade(text: str, model: BandModels, mixed: bool = False) -> tuple[int | None, int, int]:
    """(band, words, sentences) of a text; band is None for a text without English sentences
    or, unless ``mixed``, with more words in sentences of other languages."""
    cut = [(p, words) for p in pieces(text) if (words := words_of(p))]
    if not cut:
        return None, 0, 0
    scores, lengths, english = model.score([w for _, w in cut])
    seen = int(lengths[english].sum())
    if not seen:
        return None, 0, 0
    foreign = sum(len(w) for (p, w), e in zip(cut, english, strict=True) if not e and len(w) >= 5 and not DATA.search(p))
    if foreign > seen and not mixed:
        return None, seen, int(english.sum())
    votes = np.bincount(scores[english].argmax(axis=1), minlength=len(model.bands))
    total = scores[english].sum(axis=0)
    best = max(range(len(votes)), key=lambda k: (votes[k], total[k], -k))
    return model.bands[best], seen, int(english.sum())


def reading_bands(corpus: DataFrame, samples: DataFrame, written: dict[str, str], min_words: int = 60, max_samples: int = 20_000, mixed: bool = False) -> DataFrame:
    """(doc_id, band, words, sentences) of each gradable document (doc_id, text).  The models
    are fitted on at most ``max_samples`` labelled rows (text, band); more rows raise."""
    labelled = [(r.text, r.band) for r in samples.select("text", "band").distinct().limit(max_samples + 1).collect()]
    if len(labelled) > max_samples:
        raise ValueError(f"more than {max_samples} labelled texts: pass a sample or raise max_samples")
    one = rewriter(written)
    model = train([(one(t), b) for t, b in labelled])
    shared = corpus.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same, bands = rewriter(written), shared.value
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                if isinstance(text, str):
                    band, words, sentences = grade(same(text), bands, mixed)
                    if band is not None and words >= min_words:
                        rows.append((key, band, words, sentences))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "band", "words", "sentences"])

    found = corpus.select("doc_id", "text").mapInPandas(read, f"doc_id {dict(corpus.dtypes)['doc_id']}, band bigint, words bigint, sentences bigint")
    return found.dropDuplicates(["doc_id"])
