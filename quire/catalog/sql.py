"""Pieces of oracle SQL."""

from quire.functions.text import QUERY_STOPWORDS, STOPWORDS

BLOCKS = "blocks as (select * exclude (rn) from (select *, row_number() over (partition by block_id order by ingested_at desc nulls last) rn from page_blocks) where rn = 1)"
CHUNKS = "chunks as (select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by written_at desc nulls last) rn from chunk_records) where rn = 1)"
HEADS = "heads as (select * exclude (rn) from (select *, row_number() over (partition by doc_id order by registered_at desc nulls last) rn from doc_heads) where rn = 1)"
STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
QSTOP = "[" + ",".join(f"'{w}'" for w in QUERY_STOPWORDS) + "]"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\\s+', ' ', 'g'))"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '\\r?\\n'), lambda l: trim(l)), lambda l: l <> '')"


def labels(rules: list[tuple[str, str]]) -> str:
    """A list of the labels whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"case when {cond} then '{name}' end" for name, cond in rules) + "], lambda x: x is not null)"


def any_of(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, '{t}')" for t in terms) + ")"
