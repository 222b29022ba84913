"""Scalar operators on sequence strings (no shuffle; Python only for whole Arrow batches)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospan.functions.core import col, let, positions
from ribospan.functions.special import (
    base_state_letters, base_state_texts, byte_table, centred_track, translated, vocabulary_ids,
)

# Alphabets.
RNA = "ACGU"
DNA = "ACGT"
STRUCTURE_STATES = "BEHLMRT"
PWM_STATE_ORDER = "LREHBMT"
# The 28-letter base+state alphabet (base-major over ACGU x BEHLMRT)
# and its reductions, letter by letter.
LETTERS_28 = "ABCDEFGHIJKLMNOPQRSTUVWXYZab"
LETTERS_16 = "DCBADADHGFEHEHLKJILILPONMPMP"
LETTERS_8 = "AAABABACCCDCDCEEEFEFEGGGHGHG"
STATES_7 = "BEHLMRT"
STATES_4 = "MULPMPM"
STATES_4_FROM = "PLUM"
STATES_2 = "PUUU"
# The tokenizer vocabulary, id = position.
VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "N", "A", "C", "G", "T"]


def normalize_rna(seq: str | Column) -> Column:
    """T becomes U and N becomes A."""
    return F.translate(col(seq), "TN", "UA")


def complement(base: str | Column) -> Column:
    """Complement of a single A/C/G/T; N, U and anything longer are unchanged."""
    c = col(base)
    return F.when(F.length(c) == 1, F.translate(c, "ACGT", "TGCA")).otherwise(c)


def substitute_base(seq: str | Column, pos0: str | Column, alt: str | Column) -> Column:
    """Replace the character at 0-based ``pos0``."""
    return F.overlay(col(seq), col(alt), col(pos0) + 1, F.lit(1))


def is_valid_record(seq: str | Column, n_track: str | Column) -> Column:
    """Alphabet ACGTUN and as many track values as bases."""
    return col(seq).rlike("^[ACGTUN]+$") & (F.length(col(seq)) == col(n_track))


def kmers(seq: str | Column, k: int) -> Column:
    """Overlapping k-mers, stride 1; empty for sequences shorter than k."""
    if k == 1:  # the split of a text into its characters walks through it once
        return F.when(F.length(col(seq)) > 0, F.split(col(seq), "")).otherwise(F.array().cast("array<string>"))
    return let(
        seq,
        lambda s: F.transform(
            positions(F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k))
        ),
    )


def kmers_text(seq: str | Column, k: int) -> Column:
    return F.concat_ws(" ", kmers(seq, k))


def kmers_to_seq(parts: str | Column) -> Column:
    """First character of each k-mer, then the rest of the last one.

    Fails where the k-mers do not have equal length steps, as a rebuilt sequence
    must be ``n + k - 1`` long.
    """
    return let(
        parts,
        lambda p: let(
            F.concat(
                F.concat_ws("", F.transform(p, lambda x: F.substr(x, F.lit(1), F.lit(1)))),
                F.substr(F.element_at(p, -1), F.lit(2)),
            ),
            lambda s: F.when(
                F.length(s) == F.size(p) + F.length(F.element_at(p, 1)) - 1, s
            ).otherwise(F.raise_error(F.lit("k-mers do not rebuild to one sequence"))),
        ),
    )


def vocabulary_kmers(k: int, alphabet: str = RNA) -> list[str]:
    """All k-mers in feature order: the first character changes fastest."""
    return ["".join(reversed(t)) for t in itertools.product(alphabet, repeat=k)]


def kmer_index(kmer: str | Column, k: int, alphabet: str = RNA) -> Column:
    """0-based position of a k-mer in :func:`vocabulary_kmers` order."""
    c = col(kmer)
    terms = [
        (F.instr(F.lit(alphabet), F.substr(c, F.lit(j + 1), F.lit(1))) - 1) * (len(alphabet) ** j)
        for j in range(k)
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def one_hot(seq: str | Column, channel: str, max_len: int | None = None) -> Column:
    """0/1 track for one channel (``T`` also matches U), zero padded on both sides to ``max_len``."""
    return weighted_one_hot(seq, None, channel, max_len)


def weighted_one_hot(
    seq: str | Column, weights: str | Column | None, channel: str, max_len: int | None = None
) -> Column:
    """Track holding ``weights[pos]`` where the base equals ``channel``, centred in ``max_len``."""
    track = centred_track("TU" if channel in "TU" else channel, max_len, weights is not None)
    text = F.upper(col(seq))
    return track(text) if weights is None else track(text, col(weights).cast("array<double>"))


def int_encode(seq: str | Column) -> Column:
    """A, C, G, T to 0..3, everything else 999."""
    return let(
        seq,
        lambda s: F.transform(
            kmers(s, 1),
            lambda c: F.when(c == "A", 0).when(c == "C", 1).when(c == "G", 2).when(c == "T", 3).otherwise(999),
        ),
    )


def tokenize_ids(tokens: str | Column, max_len: int) -> Column:
    """Struct of ``input_ids`` and ``attention_mask``: [CLS] tokens [SEP], cut and padded to ``max_len``."""
    unk, cls, sep = (VOCABULARY.index(t) for t in ("[UNK]", "[CLS]", "[SEP]"))

    def build(ids: Column) -> Column:
        pad = F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))
        return F.struct(
            F.concat(ids, F.array_repeat(F.lit(0), pad)).alias("input_ids"),
            F.concat(
                F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), pad)
            ).alias("attention_mask"),
        )

    body = F.slice(vocabulary_ids(VOCABULARY, unk)(col(tokens)), 1, max_len - 2)
    return let(F.concat(F.array(F.lit(cls)), body, F.array(F.lit(sep))), build)


def add_flanks(seq: str | Column, left: str, right: str) -> Column:
    return F.concat(F.lit(left), col(seq), F.lit(right))


def trim_flanks(seq: str | Column, n_left: int, n_right: int) -> Column:
    c = col(seq)
    return F.substr(
        c, F.lit(n_left + 1), F.greatest(F.length(c) - (n_left + n_right), F.lit(0))
    )


def has_no_n(seq: str | Column) -> Column:
    return ~F.contains(F.upper(col(seq)), F.lit("N"))


def encode_28(seq: str | Column, states: str | Column) -> Column:
    """Base string and 7-state string to the 28-letter alphabet."""
    return base_state_letters(RNA, STATES_7, LETTERS_28)(col(seq), col(states))


def reduce_alphabet(seq: str | Column, states: str | Column) -> dict[str, Column]:
    """The seven encodings of a record, keyed by alphabet name."""
    full, seven = encode_28(seq, states), col(states)
    four = F.translate(seven, STATES_7, STATES_4)
    return {
        "seq_4": col(seq),
        "seq_struct_8": F.translate(full, LETTERS_28, LETTERS_8),
        "seq_struct_16": F.translate(full, LETTERS_28, LETTERS_16),
        "seq_struct_28": full,
        "struct_2": F.translate(four, STATES_4_FROM, STATES_2),
        "struct_4": four,
        "struct_7": seven,
    }


def alphabet_texts():
    """:func:`reduce_alphabet` as a function of Arrow arrays of bases and states: a look-up for each letter of a batch."""
    spelled = base_state_texts(RNA, STATES_7, LETTERS_28)
    four = byte_table(STATES_7, STATES_4)
    of_full = {"seq_struct_8": byte_table(LETTERS_28, LETTERS_8), "seq_struct_16": byte_table(LETTERS_28, LETTERS_16)}
    of_states = {"struct_2": byte_table(STATES_4_FROM, STATES_2)[four], "struct_4": four}

    def encoded(seq, states) -> dict:
        full = spelled(seq, states)
        out = {"seq_4": seq, "seq_struct_28": full, "struct_7": states}
        out |= {a: translated(full, table) for a, table in of_full.items()}
        return out | {a: translated(states, table) for a, table in of_states.items()}

    return encoded


def text_digest(text: str | Column) -> Column:
    return F.md5(col(text))


def matrix_to_string(values: str | Column) -> Column:
    """Three-decimal values joined by commas."""
    return F.concat_ws(",", F.transform(col(values), lambda x: F.format_string("%.3f", x)))


def parse_track(text: str | Column) -> Column:
    """Comma-joined floats to an array of doubles."""
    return F.transform(F.split(col(text), ","), lambda x: F.trim(x).cast("double"))


def softmax(values: str | Column) -> Column:
    """Softmax over an array, shifted by its maximum."""
    return let(
        values,
        lambda v: let(
            F.transform(v, lambda x: F.exp(x - F.array_max(v))),
            lambda e: let(
                F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                lambda total: F.transform(e, lambda x: x / total),
            ),
        ),
    )
