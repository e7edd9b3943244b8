"""Writers: plain tables, keyed upserts, model artefacts."""
