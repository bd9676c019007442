"""The queries of this package and their SQL."""

from __future__ import annotations

from veilwork.llm.ball_kmeans import SQL as BALLS_SQL
from veilwork.llm.ball_kmeans import op13_ball_kmeans
from veilwork.llm.bpe import op6_bpe
from veilwork.llm.chat_format import SQL as CHAT_SQL
from veilwork.llm.chat_format import op4_chat_format
from veilwork.llm.hyperminhash import SQL as HYPERMINHASH_SQL
from veilwork.llm.hyperminhash import op11_hyperminhash
from veilwork.llm.media import op8_media
from veilwork.llm.mixing import SQL as MIXING_SQL
from veilwork.llm.mixing import op1_mixing
from veilwork.llm.quality_classifier import op9_quality_classifier
from veilwork.llm.quality_rules import SQL as QUALITY_SQL
from veilwork.llm.quality_rules import op2_quality_rules
from veilwork.llm.resampling import SQL as RESAMPLING_SQL
from veilwork.llm.resampling import op12_resampling
from veilwork.llm.secret_scan import op7_secret_scan
from veilwork.llm.simhash import op5_simhash
from veilwork.llm.token_counts import op10_token_counts
from veilwork.llm.warc import SQL as WARC_SQL
from veilwork.llm.warc import op3_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_chat_format": op4_chat_format,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_media": op8_media,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_hyperminhash": op11_hyperminhash,
    "op12_resampling": op12_resampling,
    "op13_ball_kmeans": op13_ball_kmeans,
}
ORACLE_SQL = {
    "op3_warc": WARC_SQL,
    "op4_chat_format": CHAT_SQL,
    "op1_mixing": MIXING_SQL,
    "op2_quality_rules": QUALITY_SQL,
    "op11_hyperminhash": HYPERMINHASH_SQL,
    "op12_resampling": RESAMPLING_SQL,
    "op13_ball_kmeans": BALLS_SQL,
}
