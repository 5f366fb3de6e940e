"""Registered queries with their SQL counterparts.

Every query reads the given tables.  Where ``pages`` lacks the markup a check looks for, a crawl is derived from the
tables by Spark: markup is added to each real page, or a row of ``part``, ``customer``, ``orders`` or ``events``
becomes a page, a header set, a sitemap entry or a lab result.  The SQL works out the expected rows from the same
tables on its own, without any markup.
"""

from . import markup, site, store, tables, text

QUERIES = {**tables.QUERIES, **text.QUERIES, **markup.QUERIES, **store.QUERIES, **site.QUERIES}
ORACLES = {**tables.ORACLES, **text.ORACLES, **markup.ORACLES, **store.ORACLES, **site.ORACLES}
