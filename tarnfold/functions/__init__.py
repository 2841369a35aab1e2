"""Part of tarnfold."""
