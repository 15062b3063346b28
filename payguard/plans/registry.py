"""All named queries of the package and their SQL."""

from payguard.plans import dashboard, documents, etl, maintained, models, olap, oltp

ALL = oltp.QUERIES | documents.QUERIES | dashboard.QUERIES | olap.QUERIES | etl.QUERIES | models.QUERIES | maintained.QUERIES
QUERIES = {name: function for name, (function, _) in ALL.items()}
ORACLES = {name: text for name, (_, text) in ALL.items() if text is not None}
