"""canopyq: HTML node tables, XPath and corpus operators as Spark plans."""
