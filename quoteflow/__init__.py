"""quoteflow: requisition and quotation data work as Spark jobs."""
