"""Training-data operators (ten methods) and their registered queries; nothing else imports this."""
