"""Analytics over payment-channel gossip history, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
