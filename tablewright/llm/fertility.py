"""Quality rules from tokeniser fertility.

Two public vocabularies encode each whole text: byte-level BPE ranks for many languages, and word pieces that fall
back to bytes. Three measures follow for each: characters per token, the share of tokens that are no whole
characters (byte fallback), and the entropy of the text's own token distribution in bits. Each language, or the script
where the language is unknown, has a band for each vocabulary; a text outside one of its bands is rejected. Bands are
fitted by ``fit_bands``. Fixed base rules on words come first.

Null and empty texts have no words and fail the base rule on length. Rows are kept one to one; repeated
rows, null ids and null languages are judged like others. Texts are encoded whole whatever their length; the encoder's
pattern can't match runs of white space of a million characters, so runs from RUN on are encoded apart, with the same
tokens. A text of only one kind of token has entropy 0. An empty table gives no rows. Other columns are not read, so their
names can't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LATIN_END, CYRILLIC_END = "ɐ", "԰"
#: Runs of white space of this length or more are pieces of their own but for their last character, as the pattern has them.
RUN = 100_000
LONG_RUN = re.compile(rf"[^\S\x1c-\x1f]{{{RUN},}}")
#: Files of vocabularies: ranks of byte-level BPE, and a model of pieces.
VOCABULARIES = {"bytes": "byte_bpe_multi_50k.tiktoken", "pieces": "piece_bpe_32k.model"}


@dataclass(frozen=True)
class Band:
    """Accepted range of characters per token, most byte fallback, least token entropy."""

    chars_min: float
    chars_max: float
    fallback_max: float
    entropy_min: float

    def accepts(self, chars: float, fallback: float, entropy: float) -> bool:
        return self.chars_min <= chars <= self.chars_max and fallback <= self.fallback_max and entropy >= self.entropy_min


#: Bands by language, then vocabulary: what ``fit_bands`` gives for sf0.1. By script for other languages: wide ones, set by hand.
BANDS = {
    "de": {"bytes": Band(2.414, 8.0, 0.043, 5.562), "pieces": Band(2.297, 8.0, 0.039, 5.496)},
    "en": {"bytes": Band(2.328, 8.0, 0.01, 5.464), "pieces": Band(2.223, 8.0, 0.044, 5.433)},
    "es": {"bytes": Band(2.183, 8.0, 0.032, 5.43), "pieces": Band(2.044, 8.0, 0.036, 5.5)},
    "fr": {"bytes": Band(2.015, 8.0, 0.033, 5.367), "pieces": Band(1.873, 8.0, 0.056, 5.272)},
    "latin": {"bytes": Band(1.5, 9.0, 0.15, 5.0), "pieces": Band(1.2, 9.0, 0.30, 4.8)},
    "cyrillic": {"bytes": Band(0.8, 9.0, 0.30, 5.0), "pieces": Band(0.8, 9.0, 0.60, 4.8)},
    "other": {"bytes": Band(0.3, 9.0, 0.95, 4.5), "pieces": Band(0.3, 9.0, 0.98, 4.3)},
}


def default_paths() -> dict[str, str]:
    import public_tokenizers

    return {k: public_tokenizers.path(f) for k, f in VOCABULARIES.items()}


@cache
def ranks_of(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder, and by token id whether it is no whole characters."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    partial = np.zeros(max(ranks.values()) + 1, bool)
    for token, i in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            partial[i] = True
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), partial


@cache
def pieces_of(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """The encoder, and by token id whether it stands for a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.fromiter(map(model.is_byte, range(model.get_piece_size())), bool)


def encode(text: str, coder: tiktoken.Encoding) -> list[int]:
    """Token ids of the whole text."""
    out, at = [], 0
    for m in LONG_RUN.finditer(text) if len(text) >= RUN else ():
        cut = m.end() - (m.end() < len(text))  # the last character may belong to the next word's piece
        out += coder.encode_ordinary(text[at : m.start()]) + coder._encode_single_piece(text[m.start() : cut])
        at = cut
    return out + coder.encode_ordinary(text[at:]) if at else coder.encode_ordinary(text)


def encoders(paths: dict[str, str]) -> list[tuple[Callable[[str], list[int]], np.ndarray]]:
    """For each vocabulary, in order: text -> token ids, and by id whether the token is no whole characters."""
    coder, partial = ranks_of(paths["bytes"])
    model, byte = pieces_of(paths["pieces"])
    return [(lambda t: encode(t, coder), partial), (lambda t: model.encode(t, num_threads=1), byte)]


def fertility(text: str, ids: list[int], partial: np.ndarray) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share, token entropy in bits."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    # sorted ids, not a count for each id of the vocabulary: most texts are far shorter than that
    tokens = np.fromiter(ids, np.int32, n)
    tokens.sort()
    first = np.append(0, np.flatnonzero(tokens[1:] != tokens[:-1]) + 1)
    count = np.diff(first, append=n)
    share = count / n
    return n, len(text) / n, float(count[partial[tokens[first]]].sum() / n), float(-(share * np.log2(share)).sum())


def script(text: str) -> str:
    """The script that most letters are in."""
    letters = [c for c in text if c.isalpha()]
    latin = sum(c < LATIN_END for c in letters)
    cyrillic = sum(LATIN_END <= c < CYRILLIC_END for c in letters)
    return max((latin, "latin"), (cyrillic, "cyrillic"), (len(letters) - latin - cyrillic, "other"))[1]


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    code = {w: i for i, w in enumerate(set(words))}
    if len(words) < 4 or len(code) == len(words):
        return 0
    ids, size = np.fromiter(map(code.__getitem__, words), np.int64, len(words)), len(code)
    pairs = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 21:  # else three numbers fit one of 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * size + ids[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    found, hit = np.isin(windows, again), np.zeros(len(words), bool)
    for i in range(3):
        hit[i : i + len(found)] |= found
    return int(hit.sum())


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated 3-word windows."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at BLANK alone
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


MEASURES = [f"{k}_{m}" for k in VOCABULARIES for m in ("tokens", "chars_per_token", "fallback_share", "token_entropy")]
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"{m} {'long' if m.endswith('_tokens') else 'double'}" for m in MEASURES)
)


def judge(docs: DataFrame, paths: dict[str, str] | None = None, bands: dict[str, dict[str, Band]] = BANDS) -> DataFrame:
    """One row per document: the base counts, the verdicts, and the measures by each vocabulary."""
    paths = paths or default_paths()

    def run(cols: dict) -> dict:
        rows, coders = [], encoders(paths)
        for doc, text, lang in zip(cols["doc_id"], cols["text"], cols["lang"], strict=True):
            text = text or ""
            base = base_rules(text)
            failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
            measures = [fertility(text, encoded(text), partial) for encoded, partial in coders]
            own = bands.get(lang) or bands[script(text)]
            kept = not failed and all(own[k].accepts(*m[1:]) for k, m in zip(VOCABULARIES, measures, strict=True))
            rows.append((doc, *base, failed, kept, *measures[0], *measures[1]))
        return dict(zip((x.split()[0] for x in SCHEMA.split(", ")), map(list, zip(*rows, strict=True)), strict=True))

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return map_batches(read, run, SCHEMA)


#: Of good texts at each end of a measure, the share that a band may leave out, and the margin added beyond.
TAIL, MARGIN = 0.001, 0.05
#: The upper end isn't fitted: labelled texts may hold rarer words than others, of which tokens are shorter.
CHARS_MAX = 8.0


def fit_bands(judged: DataFrame, docs: DataFrame, labels: DataFrame) -> dict[str, dict[str, Band]]:
    """Bands by language: of the texts that pass the base rules and are labelled good, outside every third id by its crc32, the quantile
    TAIL or 1 - TAIL of each measure, and MARGIN beyond. Quantile sketches are merged, a row for each language reaches the driver."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    rows = judged.where("not base_failed").join(good, "doc_id").join(docs.select("doc_id", "lang").distinct(), "doc_id")
    at = lambda m, q: F.percentile_approx(m, q, 10_000)
    ends = [x for k in VOCABULARIES for x in (at(f"{k}_chars_per_token", TAIL), at(f"{k}_fallback_share", 1 - TAIL), at(f"{k}_token_entropy", TAIL))]
    found = rows.where("lang is not null").groupBy("lang").agg(*(x.alias(f"x{i}") for i, x in enumerate(ends))).collect()
    out: dict[str, dict[str, Band]] = {}
    for r in found:
        for i, k in enumerate(VOCABULARIES):
            chars, fallback, entropy = (r[f"x{3 * i + j}"] for j in range(3))
            band = Band(round(chars * (1 - MARGIN), 3), CHARS_MAX, round(fallback * (1 + MARGIN) + 0.01, 3), round(entropy * (1 - MARGIN), 3))
            out.setdefault(r["lang"], {})[k] = band
    return out


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the fertility verdict for every whole text of ``documents``."""
    return judge(table(spark, sf_dir, "documents"))
