"""Files, corpora, options, model connectors and the audit trail."""
