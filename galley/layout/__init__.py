"""Layout of pages: from objects on paper to paragraphs, tables and figures."""
