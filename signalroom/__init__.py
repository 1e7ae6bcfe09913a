"""signalroom: content-provenance and text-hygiene analytics expressed as Spark DataFrame plans."""
