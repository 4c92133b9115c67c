"""The registered queries of the operators in this folder, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bitpack, html_text, lattice, licenses, linededup, minhash, mixing, oracles, piece, quality, secrets
from tidemark.session import remove, scope, scratch_path, table

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files lie on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Every query reads its whole table: no limit, sample or subset.  An empty table
# gives an empty result of the same columns; columns that a query does not name
# are not read, so their names do not matter.


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty html gives the empty text.  Pages are independent: repeated
    rows give repeated results, a page of any length is labelled as a whole.  A
    block whose score is exactly one half is main text."""
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base measurements, base_failed, kept and bits of every row
    of ``documents``.

    The ledger is written first; the policy reads its bits alone.  A null or
    empty text has no words and fails few_words.  Repeated rows and doc_ids
    give rows of their own; a measurement equal to a rule's bound passes."""
    path = scratch_path(spark, "ledger")
    with scope(spark) as keep:
        led = quality.store(table(spark, sf_dir, "documents"), path)
        base = (led["bits"].bitwiseAND(quality.BASE) != 0).alias("base_failed")
        out = keep(quality.apply_policy(led).select("doc_id", *quality.MEASURES[:5], base, "kept", "bits"), "quality")
        remove(spark, path)
    return out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of
    ``documents``.

    A null or empty text has no findings; texts and secrets may be of any
    length, and hold any number of findings.  Findings of one start come in
    the order of the rules.  Rows are independent, repeated ones too."""
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``documents``, read
    from the files.

    A null or empty text is the end id alone; a text of any length is one
    document.  Rows that share a doc_id lie in the order of their ids' bytes,
    rows without one come first; repeated rows stay."""
    return bitpack.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(WORD_TOKENIZER), end_id=2)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, n_tokens, epoch, rank of every emitted row.

    A null source is the source ''; null and empty texts carry no weight and go
    with their block; repeated rows go together; equal draws fall to the
    smaller block.  Texts may be of any length."""
    return mixing.report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of
    ``documents``.

    A null or empty text is begin and end id; texts and words may be of any
    length.  Of equal ranks the leftmost pair merges first, as in the library.
    Rows are independent, repeated ones too."""
    return piece.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(PIECE_MODEL))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_chars_kept, kept_sha256 of every row
    of ``documents``.

    A null text has no lines; lines without a word never go.  Of equal lines
    the first by doc_id (null first), text hash and place stays.  Rows equal in
    doc_id and text lose the same lines.  Texts and lines may be of any
    length."""
    return linededup.report(table(spark, sf_dir, "documents").select("doc_id", "text"), linededup.EXACT_FROM, linededup.NEAR_FROM)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, component_id, kept of every row of ``documents``.

    Texts without words, null ones too, link with nothing.  Rows that share a
    doc_id or have none are told apart by their texts; of equal rows one is
    kept.  A similarity of exactly 0.8 links.  Texts may be of any length."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, licenses, templates of every row of ``documents``.

    A null or empty text has none; texts may be of any length.  Names are
    sorted and listed once; of near wordings of a family that tie, all are
    listed.  Rows are independent, repeated ones too."""
    return licenses.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing.  Rows that share a vec_id or have none are vectors of
    their own; equal vectors are linked.  A cosine of exactly 0.95 links."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_quality_rules, op3_secret_scan, op4_bit_packing, op5_source_mixing, op6_sentencepiece, op7_line_dedup, op8_minhash_near_dedup, op9_license_scan, op10_lattice_near_dedup)
}
ORACLES: dict[str, str] = oracles.ORACLES
