"""Column functions on sequences: normalising, augmenting, segmenting, tokenising."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .random import hash_number

#: The twenty residues, alphabetically by letter, which is their order as integers.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: The vocabulary for single residues.
RESIDUE_VOCABULARY = {t: i for i, t in enumerate(["<PAD>", "<MASK>", "<CLS>", "<SEP>", "<UNK>", *"ABCDEFGHIKLMNOPQRSTUVWXYZ", "<START>", "<STOP>", "-"])}


#: Average masses of the residues, of water, and of the change from acid to amide at the end.
RESIDUE_MASS = {"A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411, "I": 113.1594, "K": 128.1741, "L": 113.1594, "M": 131.1926, "N": 114.1038, "P": 97.1167, "Q": 128.1307, "R": 156.1875, "S": 87.0782, "T": 101.1051, "V": 99.1326, "W": 186.2132, "Y": 163.1760}
WATER_MASS, AMIDE_MASS = 18.01528, -0.98476


def lookup(values: Mapping) -> Column:
    """A map column of the values of a dict."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def keep_upper(s: Column) -> Column:
    """Only A to Z."""
    return F.regexp_replace(s, "[^A-Z]", "")


def normalise(s: Column) -> Column:
    """Upper-cased, then only A to Z."""
    return keep_upper(F.upper(s))


def ascii_only(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def is_valid(s: Column, max_length: int | None = None) -> Column:
    """A non-empty string of the twenty residues, of at most max_length letters; false for null."""
    ok = s.rlike(f"^[{RESIDUES}]+$")
    return F.coalesce(ok & (F.length(s) <= max_length) if max_length else ok, F.lit(False))


def flip(s: Column, key: Column, seed: int = 0, p: float = 0.5) -> Column:
    """The reversed sequence with probability p, drawn from the key; always a value, unless s is null."""
    return F.when(hash_number("flip", seed, key) < int(p * (1 << 32)), F.reverse(s)).otherwise(s)


def _draw(seed: int, key: Column, i: Column, salt: str) -> Column:
    return hash_number(salt, seed, key, i)


def noise(s: Column, key: Column, p: float = 0.1, seed: int = 0, alphabet: str = RESIDUES) -> Column:
    """Each letter replaced with probability p by one of the alphabet, possibly itself; p is clipped to [0, 1]."""
    limit = int(min(max(p, 0.0), 1.0) * (1 << 32))
    letters = F.array(*[F.lit(a) for a in alphabet])
    drawn = lambda i: F.get(letters, F.pmod(_draw(seed, key, i, "letter"), F.lit(len(alphabet))).cast("int"))
    return F.array_join(F.transform(characters(s), lambda c, i: F.when(_draw(seed, key, i, "noise") < limit, drawn(i)).otherwise(c)), "")


def site_noise(s: Column, key: Column, p_outside: float = 0.01, p_inside: float = 0.1, seed: int = 0) -> Column:
    """noise() with one probability for active sites (letters up to Z) and one outside, where drawn letters are lower case."""
    letters = F.array(*[F.lit(a) for a in RESIDUES])

    def one(c: Column, i: Column) -> Column:
        new = F.get(letters, F.pmod(_draw(seed, key, i, "letter"), F.lit(len(RESIDUES))).cast("int"))
        u = _draw(seed, key, i, "noise")
        return F.when((c <= "Z") & (u < int(p_inside * (1 << 32))), new).when((c > "Z") & (u < int(p_outside * (1 << 32))), F.lower(new)).otherwise(c)

    return F.array_join(F.transform(characters(s), one), "")


def case_runs(s: Column) -> Column:
    """Maximal runs of characters up to Z (active) and of others; joined, they are s. No runs for an empty string."""
    return F.regexp_extract_all(s, F.lit(r"([\x00-Z]+|[^\x00-Z]+)"), F.lit(1))


def is_active(run: Column) -> Column:
    return F.substring(run, 1, 1) <= "Z"


def flip_runs(s: Column, key: Column, p: float = 0.5, seed: int = 0) -> Column:
    """Each active run reversed with probability p."""
    limit = int(p * (1 << 32))
    return F.array_join(F.transform(case_runs(s), lambda r, i: F.when(is_active(r) & (_draw(seed, key, i, "run") < limit), F.reverse(r)).otherwise(r)), "")


def attention_mask(tokens: Column, value: bool = True) -> Column:
    """An array of value, as long as tokens."""
    return F.transform(tokens, lambda _: F.lit(value))


def encode_residues(s: Column) -> Column:
    """Residues as integers from 0; fails on other characters."""
    codes = lookup({a: i for i, a in enumerate(RESIDUES)})
    one = lambda c: F.coalesce(F.element_at(codes, c), F.raise_error(F.concat(F.lit("unknown residue "), c)).cast("int"))
    return F.transform(characters(s), one)


def decode_residues(codes: Column) -> Column:
    """The reverse; 20 is X."""
    letters = F.array(*[F.lit(a) for a in RESIDUES + "X"])
    return F.array_join(F.transform(codes, lambda i: F.get(letters, i)), "")


def split_tokens(s: Column) -> Column:
    """Tokens in angle brackets, and the other characters one by one."""
    return F.regexp_extract_all(s, F.lit("(<[^>]*>|[^<>])"), F.lit(1))


def token_ids(s: Column, vocabulary: Mapping[str, int], unknown: str = "<UNK>") -> Column:
    """Ids of the non-blank tokens of s in a vocabulary of whole tokens."""
    tokens = F.filter(split_tokens(s), lambda t: ~t.rlike(r"^\s$"))
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(lookup(vocabulary), t), F.lit(vocabulary[unknown])))


def pad(ids: Column, size: int, pad_id: int = 0) -> Column:
    """Cut or filled on the right to a size."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), size)), 1, size)


def padded_mask(ids: Column, size: int) -> Column:
    """True for each place that pad() fills from ids."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i <= F.size(ids))


def ends_with(s: Column, eos: str) -> Column:
    """s, or a failure if it does not end with eos, blanks aside."""
    return F.when(F.rtrim(s).endswith(eos), s).otherwise(F.raise_error(F.concat(F.lit(f"does not end with {eos}: "), s)))


def word_tokens(s: Column, size: int, start: str = "<start>", eos: str = "<eos>", filler: str = "<pad>") -> Column:
    """Lower-cased words between start and eos, cut or filled to a size; eos stays when words are cut."""
    words = F.slice(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != ""), 1, size - 2)
    return F.slice(F.concat(F.array(F.lit(start)), words, F.array(F.lit(eos)), F.array_repeat(F.lit(filler), size)), 1, size)


def roll(tokens: Column, shift: Column | int) -> Column:
    """Tokens moved to the right by shift places, those at the end coming first; an empty array stays so."""
    n = F.size(tokens)
    k = F.pmod(F.lit(shift) if isinstance(shift, int) else shift, F.when(n > 0, n))
    return F.coalesce(F.concat(F.slice(tokens, n - k + 1, k), F.slice(tokens, 1, n - k)), tokens)


def random_roll(tokens: Column, key: Column, max_fraction: float, seed: int = 0) -> Column:
    """roll() by less than the fraction of the length; no shift where that is below one."""
    most = F.floor(F.size(tokens) * max_fraction).cast("int")
    return F.when(most > 0, roll(tokens, F.pmod(hash_number("roll", seed, key), most).cast("int"))).otherwise(tokens)


def dropout(tokens: Column, key: Column, p: float, value: int = 0, seed: int = 0) -> Column:
    """Each token replaced by value with probability p."""
    return F.transform(tokens, lambda t, i: F.when(_draw(seed, key, i, "drop") < int(p * (1 << 32)), F.lit(value)).otherwise(t))


def override(tokens: Column, key: Column, p: float, values: list[int], seed: int = 0) -> Column:
    """Each token replaced with probability p by one of values."""
    held = F.array(*[F.lit(v) for v in values])
    new = lambda i: F.get(held, F.pmod(_draw(seed, key, i, "value"), F.lit(len(values))).cast("int"))
    return F.transform(tokens, lambda t, i: F.when(_draw(seed, key, i, "override") < int(p * (1 << 32)), new(i)).otherwise(t))


def swap_adjacent(tokens: Column, key: Column, p: float, seed: int = 0) -> Column:
    """Tokens exchanged with their right neighbour with probability p: never the last, nor one drawn next to a drawn one."""
    u = lambda i: _draw(seed, key, i, "swap") < int(p * (1 << 32))
    n = F.size(tokens)
    swaps = lambda i: (i >= 0) & (i < n - 1) & u(i) & ~((i > 0) & u(i - 1))
    return F.transform(tokens, lambda t, i: F.when(swaps(i), F.get(tokens, i + 1)).when(swaps(i - 1), F.get(tokens, i - 1)).otherwise(t))


def best_tokens(logits: Column, vocabulary: list[str], eos: str = "<eos>") -> Column:
    """Text of an array of logit arrays: the best token of each place up to eos, without tokens that start with <."""
    names = F.array(*[F.lit(t) for t in vocabulary])
    tokens = F.transform(logits, lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int")))
    stop = F.array_position(tokens, eos)
    upto = F.when(stop > 0, F.slice(tokens, 1, (stop - 1).cast("int"))).otherwise(tokens)
    return F.array_join(F.filter(upto, lambda t: ~t.startswith("<")), "")


def molecular_weight(s: Column, amide: bool = True) -> Column:
    """Average mass of a peptide; null if a letter is not one of the twenty residues."""
    masses = F.transform(characters(s), lambda c: F.element_at(lookup(RESIDUE_MASS), c))
    ends = F.lit(WATER_MASS + (AMIDE_MASS if amide else 0.0))
    return F.when(is_valid(s), F.aggregate(masses, ends, lambda total, m: total + m))


def mix_vectors(vectors: Column, others: Column, key: Column, p: float, weight: float = 0.2, seed: int = 0) -> Column:
    """Token vectors, each replaced with probability p by a mean of itself and, at the weight, one of others."""

    def one(v: Column, i: Column) -> Column:
        other = F.get(others, F.pmod(_draw(seed, key, i, "other"), F.size(others)).cast("int"))
        return F.when(_draw(seed, key, i, "mix") < int(p * (1 << 32)), F.zip_with(v, other, lambda x, y: x * (1 - weight) + y * weight)).otherwise(v)

    return F.transform(vectors, one)
