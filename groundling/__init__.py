"""Source-grounding analytics on PySpark: route, normalise, pack, claim-check and guard text at corpus scale."""
