"""The query dialect: text to tokens to statements."""
