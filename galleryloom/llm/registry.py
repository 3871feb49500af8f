"""All queries of the training-data operators and the SQL that checks them."""

import corpus_pipeline
from galleryloom.llm import bpe, decontaminate, langid, licenses, neighbours, quality, resample, runs, secrets, shuffle, simhash, urlfilter, warc

MODULES = (neighbours, bpe, langid, urlfilter, decontaminate, simhash, secrets, quality, shuffle, warc, licenses, resample, runs)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
