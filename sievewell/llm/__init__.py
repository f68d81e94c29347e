"""Training-data operators: filtering, de-duplication, classification, mixing, sharding and archives."""
