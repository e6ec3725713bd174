"""Training-data operators over text corpora. Nothing else imports this package."""
