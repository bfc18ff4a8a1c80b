"""Training-data operators (documents, pages, benchmark). Nothing else in the library imports this."""
