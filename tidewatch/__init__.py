"""Event-rule analytics and corpus operators expressed as Spark plans."""
