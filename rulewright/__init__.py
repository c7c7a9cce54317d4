"""Business rules over batches and streams of events, compiled to DataFrame plans."""
